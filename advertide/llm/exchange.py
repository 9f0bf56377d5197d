"""Sorted hashes on the wire, blocks of documents, and shared staging."""

from __future__ import annotations

import math

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pack(values: np.ndarray) -> bytes:
    """Ascending 64-bit values as differences, stored byte plane by byte plane and compressed."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def pack_counts(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<u4").tobytes())


def unpack_counts(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype="<u4")


def bucket_edges(values: np.ndarray, bits: int, width: int = 64) -> np.ndarray:
    """Where each bucket begins in ascending values of ``width`` bits; a bucket is their first ``bits`` bits."""
    firsts = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(width - bits)
    return np.concatenate([[0], np.searchsorted(values, firsts), [len(values)]])


def pieces_for(rows: int, rows_per_piece: int) -> int:
    return max(1, math.ceil(rows / rows_per_piece))


def cut_points(df: DataFrame, column: str, pieces: int) -> list[int]:
    """Values that cut an integer column into ``pieces`` runs of about as many rows; one pass over the column."""
    if pieces < 2:
        return []
    fractions = [i / pieces for i in range(1, pieces)]
    found = df.agg(F.percentile_approx(column, fractions, max(10_000, 20 * pieces)).alias("cuts")).first()[0]
    return sorted(set(found or ()))


def _at_most(column: Column, values: Column) -> Column:
    return F.size(F.filter(values, lambda c: c <= column))


def run_of(column: Column, cuts: list[int]) -> Column:
    """Which run a value lies in: 0 below the first cut; a null lies behind the last.

    The cuts are searched in two levels, so a row costs about twice the root of their number.
    """
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts) - 1) + 1
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    coarse = F.expr(f"array({', '.join(f'{g[0]}L' for g in groups)})")
    fine = F.expr("array(" + ", ".join(f"array({', '.join(f'{c}L' for c in g)})" for g in groups) + ")")
    group = _at_most(column, coarse)
    inner = (group - 1) * step + _at_most(column, F.element_at(fine, group))
    return F.when(column.isNull(), len(cuts)).when(group == 0, 0).otherwise(inner)
