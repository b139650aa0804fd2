"""Where points, rasters and features come from and go to."""
