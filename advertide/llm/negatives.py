"""Mine hard negatives for anchors by a secondary sort of their pair scores.

1. *Positives.* Blocks of vectors meet slices of anchors; a block keeps an
   anchor's best rows of its own label, and the first few of all blocks are its
   positives. Each opens a window of scores between two shares of its own.
2. *Negatives.* The same blocks meet the same slices again, now with the windows:
   a block keeps of every window the first few rows of other labels. No later
   row of the block can be among the window's first few of the corpus.
3. *Secondary sort.* What is left of the pairs is packed into keys (anchor,
   descending score, positives before negatives, id), dealt by anchor and sorted
   inside the partitions by ``repartitionAndSortWithinPartitions``. One iterator
   reads a partition from front to back: a positive opens its window, a negative
   goes to every open window that still wants one. At any time it holds the
   windows of one anchor, never its pairs.

Equal rows are one row with a number of copies before anything is dealt, so a
row repeated without end is no hot spot. Blocks and slices are dealt by hash;
a label never decides where a row goes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from advertide.llm.exchange import pieces_for
from advertide.session import stage

BLOCK_VECTORS, SLICE_ANCHORS = 16384, 4096
# Anchors scored at a time: their scores are one dense array.
SCORED_AT_ONCE = 128
# Anchor and score as unsigned big-endian numbers, so that bytes sort as the numbers do.
KEY = struct.Struct(">QQBQ")
_LEAST = 1 << 63
FOUND = "anchor_id long, score long, vec_id long"
MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def labelled(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, label, terms, copies``: floor(scale * x) of every component, equal rows counted as copies.

    Rows without an id, label or vector, or with a null or non-finite component, are left out.
    """
    whole = vectors.where("vec_id is not null and label is not null and embedding is not null").select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    broken = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    terms = F.transform("embedding", lambda x: F.floor(x * scale).cast("long")).alias("terms")
    whole = whole.where(~F.coalesce(broken, F.lit(True))).select("vec_id", "label", terms)
    return whole.groupBy("vec_id", "label", "terms").agg(F.count("*").alias("copies"))


def _matrix(terms: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(terms), width), dtype=np.int64)
    for row, values in zip(out, terms):
        row[: len(values)] = values
    return out


def _scored(anchors: pd.DataFrame, held: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """Anchor by anchor its exact scores with all held rows; a component that a vector lacks counts as 0."""
    width = max(1, max(map(len, anchors["terms"])), max(map(len, held["terms"])))
    left, right = _matrix(anchors["terms"], width), _matrix(held["terms"], width)
    most = float(np.abs(left.astype(float)).max()) * float(np.abs(right.astype(float)).max()) * width
    if most < 2**53:  # sums of doubles are exact below
        left, right = left.astype(np.float64), right.astype(np.float64)
    right = np.ascontiguousarray(right.T)
    for at in range(0, len(left), SCORED_AT_ONCE):
        scores = left[at : at + SCORED_AT_ONCE] @ right
        yield from enumerate(scores, at)


def _rows(found: list[tuple[int, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    counts = [len(s) for _, s, _ in found]
    scores = [s for _, s, _ in found] or [np.empty(0)]
    ids = [v for _, _, v in found] or [np.empty(0)]
    return pd.DataFrame(
        {
            "anchor_id": np.repeat(np.array([a for a, _, _ in found], dtype=np.int64), counts),
            "score": np.concatenate(scores).astype(np.int64),
            "vec_id": np.concatenate(ids).astype(np.int64),
        }
    )


def _best_positives(k: int):
    def search(held: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(held) and len(anchors):
            held = held.sort_values("vec_id", kind="stable")
            ids, labels, copies = (held[c].to_numpy() for c in ("vec_id", "label", "copies"))
            by_label = {label: np.flatnonzero(labels == label) for label in set(anchors["label"])}
            own = list(zip(anchors["vec_id"], anchors["label"]))
            for i, scores in _scored(anchors, held):
                anchor, label = own[i]
                same = by_label[label]
                same = same[ids[same] != anchor]
                best = same[np.argsort(-scores[same], kind="stable")[:k]]
                best = np.repeat(best, np.minimum(copies[best], k))[:k]
                found.append((anchor, scores[best], ids[best]))
        return _rows(found)

    return search


def windows_of(scores: list[int], low: int, high: int) -> list[tuple[int, int]]:
    """Least and greatest negative score of each positive score's window; empty ones are left out."""
    ends = {(-(-low * int(s) // 100), high * int(s) // 100) for s in scores}
    return sorted(w for w in ends if w[0] <= w[1])


def _first_negatives(k: int, low: int, high: int):
    def search(held: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(held) and len(anchors):
            held = held.sort_values("vec_id", kind="stable")
            ids, labels, copies = (held[c].to_numpy() for c in ("vec_id", "label", "copies"))
            own = list(zip(anchors["vec_id"], anchors["label"], anchors["scores"]))
            for i, scores in _scored(anchors, held):
                anchor, label, positives = own[i]
                ends = windows_of(positives, low, high)
                if not ends:
                    continue
                wanted = (scores >= ends[0][0]) & (scores <= ends[-1][1]) & (labels != label) & (ids != anchor)
                other = np.flatnonzero(wanted)
                other = other[np.argsort(-scores[other], kind="stable")]
                falling = -scores[other]
                kept = np.zeros(len(other), dtype=bool)
                for least, most in ends:
                    begin = np.searchsorted(falling, -most, "left")
                    end = np.searchsorted(falling, -least, "right")
                    kept[begin : min(end, begin + k)] = True
                other = other[kept]
                other = np.repeat(other, np.minimum(copies[other], k))
                found.append((anchor, scores[other], ids[other]))
        return _rows(found)

    return search


def packed(anchor: int, score: int, negative: bool, vec_id: int) -> bytes:
    """A key whose bytes sort by anchor, descending score, positives before negatives, id."""
    return KEY.pack(anchor + _LEAST, _LEAST - 1 - score, negative, vec_id + _LEAST)


def unpacked(key: bytes) -> tuple[int, int, bool, int]:
    anchor, score, negative, vec_id = KEY.unpack(key)
    return anchor - _LEAST, _LEAST - 1 - score, bool(negative), vec_id - _LEAST


def by_anchor(key: bytes) -> int:
    return zlib.crc32(key[:8])


def emitted(keys, positives: int, negatives: int, low: int, high: int) -> Iterator[tuple]:
    """Rows of :func:`mined` from one partition's keys in order, holding the open windows of one anchor."""
    current, opened, windows = None, 0, []
    for key, _ in keys:
        anchor, score, negative, vec_id = unpacked(key)
        if anchor != current:
            current, opened, windows = anchor, 0, []
        if not negative:
            if opened < positives:
                opened += 1
                windows.append([vec_id, score, 0])
            continue
        for window in windows:
            if low * window[1] <= 100 * score <= high * window[1]:
                window[2] += 1
                yield anchor, window[0], window[2], vec_id, window[1], score
        # Scores fall from here on: a full window, or one that the scores have passed, is closed.
        windows = [w for w in windows if w[2] < negatives and low * w[1] <= 100 * score]


def mined(
    vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the ids divisible by ``every``. An anchor's positives are its first
    other rows of the same label by descending integer inner product, ties by smaller
    id. Of the rows of other labels whose score lies between ``low`` and ``high``
    percent of a positive's score, the first ``negatives`` are returned, ``rank``
    from 1.

    Rows without an id, label or vector, or with a null or non-finite component take
    no part; an empty vector scores 0 with everything. Rows that share the anchor's id
    are the anchor itself, read by the least label and vector among them. A row that
    is repeated counts as often as it stands in the table, so it may be a positive or
    a negative more than once. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    own = stage(labelled(vectors), "negatives-vectors")
    asked = own.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "terms")).alias("row"))
    asked = stage(asked.select("vec_id", "row.label", "row.terms"), "negatives-anchors")
    blocks, slices = pieces_for(own.count(), BLOCK_VECTORS), pieces_for(asked.count(), SLICE_ANCHORS)
    dealt = lambda columns, n: F.pmod(F.xxhash64(*columns, F.lit("dealt")), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = own.select("*", dealt(["vec_id", "label", "terms"], blocks).alias("block"), each(slices).alias("slice"))
    asked = asked.withColumn("slice", dealt(["vec_id"], slices))

    def met(anchors: DataFrame, search) -> DataFrame:
        wanted = anchors.select("*", each(blocks).alias("block"))
        return held.groupBy("block", "slice").cogroup(wanted.groupBy("block", "slice")).applyInPandas(search, FOUND)

    order = Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "vec_id")
    near = met(asked, _best_positives(positives)).withColumn("place", F.row_number().over(order))
    near = stage(near.where(F.col("place") <= positives).drop("place"), "negatives-positives")
    scores = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list("score").alias("scores"))
    far = met(asked.join(scores, "vec_id"), _first_negatives(negatives, low, high))

    pairs = near.withColumn("negative", F.lit(False)).unionByName(far.withColumn("negative", F.lit(True)))
    keys = pairs.rdd.map(lambda r: (packed(r.anchor_id, r.score, r.negative, r.vec_id), None))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.repartitionAndSortWithinPartitions(width, by_anchor)
    rows = ordered.mapPartitions(lambda part: emitted(part, positives, negatives, low, high))
    return spark.createDataFrame(rows, MINED)


def relabelled(vectors: DataFrame, divisor: int = 7, labels: int = 10) -> DataFrame:
    """The label moved on by one, round ``labels``, where the id is divisible by ``divisor``; null ids keep theirs."""
    moved = (F.col("label") + 1) % labels
    return vectors.withColumn("label", F.when(F.col("vec_id") % divisor == 0, moved).otherwise(F.col("label")))
