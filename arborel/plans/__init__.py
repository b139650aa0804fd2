"""Whole segmentation plans and the registered queries."""
