"""Kernels, colours and names."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Colours that a palette of ids goes round.
PALETTE_SIZE = 20


def gaussian_kernel(sigma: float, n: int = 7) -> list[tuple[int, int, float]]:
    """(column offset, row offset, weight) of an n x n Gaussian whose weights sum to 1; n is odd."""
    half = n // 2
    cells = [(i, j, math.exp(-(i * i + j * j) / (2 * sigma * sigma)) / (2 * math.pi * sigma * sigma)) for i in range(-half, half + 1) for j in range(-half, half + 1)]
    total = sum(w for *_, w in cells)
    return [(i, j, w / total) for i, j, w in cells]


def palette_index(rank: Column) -> Column:
    """The place in the palette of the id with this rank, from 1."""
    return ((rank - 1) % PALETTE_SIZE).cast("int")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """The file's name without its last extension."""
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def clamp(z: Column, low, high) -> Column:
    """z pulled into [low, high]; null stays null (least and greatest would skip it)."""
    return F.when(z.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), z)))
