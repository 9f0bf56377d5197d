"""Mix sources to target weights by cube-method balanced sampling.

Targets are word totals by source. A source that must give ``r`` times its words
has every document taken ``floor(r)`` times and once more with probability
``r - floor(r)``. Which documents are taken once more is settled by the cube
method: the vector of probabilities moves through the null space of the balance
constraints (number of documents, number of words), so both totals stay as they
are while probabilities turn into 0 or 1. Blocks of one source move on their
own; the few undecided documents of each block meet in the next level, until
one block and one small landing problem of the source are left, whatever the
number of blocks of other sources. That is solved by trying every
rounding of its members and keeping the one nearest to the word total.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from advertide.llm.fingerprints import WORDS
from advertide.session import stage

# Undecided documents left to the landing of a source; 2**LANDING roundings are tried.
LANDING = 12
# Documents of one flight: small enough for one task, large enough that few levels are needed.
BLOCK = 8192
UNIT = "key long, source string, size long, p double, unit_id long, unit_mark long, unit_rows long, unit_sure long"
# Rows of a repeated document that are numbered out of one array.
STRETCH = 10_000


def word_count(text) -> F.Column:
    """Words of a text as a long; none for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size, target`` from ``source, size``.

    Sources stand in code point order, null last, and weigh ``weights`` in turn. They
    share ``share`` times all words; a target stops at ``most`` times its source's
    words, and what is over is shared again by weight. With sources in ascending
    order of stop over weight, those that stop come first: the level at which the
    rest stands follows from running sums. One row a source: the list of sources is
    the mix's own parameter and small, documents never meet here.
    """
    own = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int")).cast("double")
    stops = own.withColumn("weight", weight).withColumn("stop", most * F.col("source_size"))
    stops = stops.withColumn("ratio", F.col("stop") / F.col("weight"))
    up_to = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    levels = stops.withColumn("stopped", F.coalesce(F.sum("stop").over(up_to), F.lit(0.0)))
    levels = levels.withColumn("rest", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(up_to), F.lit(0.0)))
    levels = levels.withColumn("level", (share * F.sum("source_size").over(whole) - F.col("stopped")) / F.col("rest"))
    levels = levels.withColumn("rank", F.row_number().over(up_to.rowsBetween(Window.unboundedPreceding, 0)))
    first_open = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("rank", "level"))).over(whole)
    levels = levels.withColumn("open", first_open["level"])
    target = F.least(F.col("stop"), F.coalesce(F.col("open") * F.col("weight"), F.col("stop")))
    return levels.select("source", "source_size", target.alias("target"))


def flight(p: np.ndarray, sizes: np.ndarray, keep: int) -> np.ndarray:
    """Move probabilities until at most ``keep`` (3 at least) are undecided; totals of p and of p * size stay.

    Three undecided members at a time span a null space of one direction, along
    which the vector moves to the nearer face of the cube: at least one is settled.
    """
    p = p.copy()
    waiting = list(np.flatnonzero((p > 0) & (p < 1))[::-1])
    held: list[int] = []
    undecided = len(waiting)
    while undecided > max(keep, 2):
        while len(held) < 3:
            held.append(waiting.pop())
        a, b, c = held
        # Orthogonal to (1, 1, 1) and to the sizes; equal sizes leave a free direction.
        u = np.array([sizes[c] - sizes[b], sizes[a] - sizes[c], sizes[b] - sizes[a]], dtype=float)
        if not u.any():
            u = np.array([1.0, -1.0, 0.0])
        u /= np.abs(u).max()
        x = p[held]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - x) / u, np.where(u < 0, -x / u, np.inf)).min()
            down = np.where(u > 0, x / u, np.where(u < 0, (x - 1) / u, np.inf)).min()
        x = x + u * up if up <= down else x - u * down
        x[np.abs(x) < 1e-11] = 0
        x[np.abs(x - 1) < 1e-11] = 1
        p[held] = x
        open_ = [i for i in held if 0 < p[i] < 1]
        undecided -= 3 - len(open_)
        held = open_
    return p


def landing(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Round the undecided so that the words come nearest to their total, then the documents to theirs."""
    p = p.copy()
    left = np.flatnonzero((p > 0) & (p < 1))
    if len(left):
        choices = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
        words = np.abs(choices @ sizes[left] - p[left] @ sizes[left])
        documents = np.abs(choices.sum(axis=1) - p[left].sum())
        p[left] = choices[np.lexsort((documents, np.round(words, 6)))[0]]
    return p


def _move(block: pd.DataFrame) -> pd.DataFrame:
    """A source's only block lands; one of several leaves its undecided to the next level."""
    last = block["slots"].iloc[0] == 1
    block = block.sort_values(["key", "unit_id", "size", "unit_mark"], kind="stable", na_position="last").reset_index(drop=True)
    p, sizes = block["p"].to_numpy(dtype=float), block["size"].to_numpy(dtype=float)
    p = flight(p, sizes, LANDING if last else 2)
    block["p"] = landing(p, sizes) if last else p
    return block.drop(columns=["slot", "slots"])


def taken_copies(sized: DataFrame, **rules) -> DataFrame:
    """How often each document is taken: ``doc_id, source, size, mark, rows, source_size, target, whole, more, copies``.

    ``sized`` has ``doc_id`` (long), ``source``, ``size`` (long) and may have ``mark`` (long), which
    tells rows apart that agree in the others. Rows alike in all are one unit of ``rows`` rows, yet
    each row is decided: every row is taken ``whole`` times and ``more`` of them once more, ``copies``
    in all. Of n rows with probability p, floor(n * p) are sure to be taken once more (moves between
    equal sizes lead there); what is left over is one row's probability, and enters the flight as one
    row of its own size. So however often a row is repeated, a source misses its target by
    no more than single rows make out. An empty document is taken by its source's ratio like any
    other. Reruns agree: blocks, order and moves follow from hashes of ids and marks.
    """
    if "mark" not in sized.columns:
        sized = sized.withColumn("mark", F.lit(0).cast("long"))
    units = sized.groupBy("doc_id", "source", "size", "mark").agg(F.count("*").alias("rows"))
    aims = targets(units.select("source", (F.col("size") * F.col("rows")).alias("size")), **rules)
    units = units.join(aims, units["source"].eqNullSafe(aims["source"])).drop(aims["source"])
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = units.withColumn("whole", F.floor(ratio + 1e-12)).withColumn("p", F.greatest(ratio - F.col("whole"), F.lit(0.0)))
    due = F.col("rows") * F.col("p")
    units = units.withColumn("sure", F.when(F.col("rows") > 1, F.floor(due + 1e-9)).otherwise(0).cast("long"))
    units = units.withColumn("p", F.when(F.col("rows") > 1, F.greatest(due - F.col("sure"), F.lit(0.0))).otherwise(F.col("p")))
    key = F.xxhash64("doc_id", "size", "mark", F.lit("unit"))
    pool = stage(units.withColumn("key", key), "mix-units")

    undecided = pool.select(
        "key", "source", "size", "p", F.col("doc_id").alias("unit_id"), F.col("mark").alias("unit_mark"),
        F.col("rows").alias("unit_rows"), F.col("sure").alias("unit_sure"),
    )
    settled, level = undecided.where((F.col("p") <= 0) | (F.col("p") >= 1)), 0
    undecided = undecided.where((F.col("p") > 0) & (F.col("p") < 1))
    while True:
        counts = undecided.groupBy("source").agg(F.count("*").alias("n")).withColumn(
            "slots", F.ceil(F.col("n") / BLOCK).cast("long")
        )
        widest = counts.agg(F.max("slots")).first()[0] or 1
        dealt = undecided.join(counts, undecided["source"].eqNullSafe(counts["source"])).drop(counts["source"])
        dealt = dealt.withColumn("slot", F.pmod(F.xxhash64("key", F.lit(level)), F.col("slots"))).drop("n")
        moved = dealt.groupBy("source", "slot").applyInPandas(_move, UNIT)
        moved = stage(moved, f"mix-level{level}")
        settled = settled.unionByName(moved.where((F.col("p") <= 0) | (F.col("p") >= 1)))
        if widest == 1:
            break
        undecided, level = moved.where((F.col("p") > 0) & (F.col("p") < 1)), level + 1
    chosen = settled.select(
        F.col("unit_id").alias("doc_id"), "source", "size", F.col("unit_mark").alias("mark"), F.col("unit_rows").alias("rows"),
        (F.col("unit_sure") + F.col("p").cast("long")).alias("more"),
    )
    aims = pool.groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("whole").alias("whole"))
    out = chosen.join(aims, chosen["source"].eqNullSafe(aims["source"])).drop(aims["source"])
    return out.select(
        "doc_id", "source", "size", "mark", "rows", "source_size", "target", F.col("whole").cast("long").alias("whole"), "more",
        (F.col("whole") * F.col("rows") + F.col("more")).cast("long").alias("copies"),
    )


def _mark(docs: DataFrame) -> F.Column:
    """A hash of a row's columns, those left out that Spark does not hash (maps and variants)."""
    hashed = [c for c in docs.columns if not any(kind in docs.schema[c].dataType.simpleString() for kind in ("map<", "variant"))]
    return F.xxhash64(*[docs[c] for c in hashed])


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), _mark(docs).alias("mark")
    )


def mix_report(docs: DataFrame, **rules) -> DataFrame:
    """One row a document: its words, its source's words and target, and the words the mix takes of it."""
    copies = taken_copies(_sized(docs), **rules)
    # Rows of a unit are numbered a stretch at a time, so that no array grows with its rows.
    each = copies.withColumn("start", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"), F.lit(STRETCH).cast("long"))))
    each = each.withColumn("row", F.explode(F.sequence("start", F.least("rows", F.col("start") + (STRETCH - 1)))))
    taken = F.col("whole") + F.when(F.col("row") <= F.col("more"), 1).otherwise(0)
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * taken).alias("taken"))


def mix(docs: DataFrame, **rules) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it, with the columns of ``docs``.

    Where only some rows of a repeated one are taken once more, the rows are written and numbered by file
    and place in it, so that no task counts all of them.
    """
    copies = taken_copies(_sized(docs), **rules).where("copies > 0")
    # A hash and the id together: texts of different ids are never taken for one another.
    unit = lambda doc_id, *rest: F.struct(F.xxhash64(doc_id, *rest).alias("hash"), F.col(doc_id).alias("id")).alias("unit")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("_id"), _mark(docs).alias("_mark"))
    rows = rows.select("doc", unit("_id", "doc.source", word_count(F.col("doc.text")), "_mark"))
    wanted = copies.select(unit("doc_id", "source", "size", "mark"), "rows", "whole", "more")
    each = rows.join(wanted, "unit")
    some = (F.col("more") > 0) & (F.col("more") < F.col("rows"))
    alike = each.where(~some).select("doc", (F.col("whole") + (F.col("more") > 0).cast("long")).alias("copies"))
    told = stage(each.where(some), "mix-repeated").select("*", "_metadata.file_path", "_metadata.row_index")
    held = told.groupBy("unit", "file_path").agg(F.count("*").alias("held"))
    earlier = Window.partitionBy("unit").orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("unit", "file_path", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("unit", "file_path").orderBy("row_index"))
    placed = told.withColumn("inside", inside).join(held, ["unit", "file_path"])
    again = (F.col("before") + F.col("inside") <= F.col("more")).cast("long")
    every = alike.unionByName(placed.select("doc", (F.col("whole") + again).alias("copies")))
    return every.select("doc", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("doc.*")
