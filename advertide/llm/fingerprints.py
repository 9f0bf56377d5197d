"""Order MinHash fingerprints of documents, in DataFrame expressions only.

A text's k-mers are runs of ``k`` words. Each k-mer is numbered among its equals
(first occurrence, second, …) and hashed with that number, so a repeated phrase
counts as often as it occurs. Order ``j`` of the hash space is the ring read
from point ``j`` of ``points``: the ``picks`` minimal k-mers under that order
are the first ones at or behind the point. They are put back into text order
and hashed as a tuple, so a moved passage changes the tuple even where the set
of k-mers is the same. The share of equal tuples estimates how near two texts
are in edit distance.

The k-mers of a text stay in one array of longs inside its row: two primitive
sorts number and select them, with no shuffle and no Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from advertide.llm.exchange import cut_points, run_of

WORDS = r"[^\x20\x09-\x0D]+"
# A packed long holds a hash above a position; texts beyond 2**PLACE_BITS k-mers share the last position.
PLACE_BITS = 26


def _packed(h: Column, place: Column) -> Column:
    """The hash's upper bits over the position; ascending by hash, then by position."""
    kept = F.shiftleft(F.shiftright(h, PLACE_BITS), PLACE_BITS)
    return kept.bitwiseOR(F.least(place, F.lit((1 << PLACE_BITS) - 1)).cast("long"))


def _run_starts(values: Column) -> Column:
    """Indices (from 0) in an ascending packed array at which a new hash begins."""
    every = F.sequence(F.lit(0), F.size(values) - 1)
    changed = F.filter(
        every,
        lambda i: (i == 0)
        | (F.shiftright(F.get(values, i), PLACE_BITS) != F.shiftright(F.get(values, i - 1), PLACE_BITS)),
    )
    return F.when(F.size(values) > 0, changed).otherwise(F.array().cast("array<int>"))


def fingerprinted(df: DataFrame, text: str, into: str, k: int = 3, points: int = 64, picks: int = 2) -> DataFrame:
    """Add ``into``: ``points`` tuple hashes of eight hex digits each, in one string.

    A null is read as the empty text. A text of fewer than ``k`` words is one k-mer
    of its own; a text without words has the k-mer of no words. Equal texts have
    equal fingerprints. Columns named ``_omh…`` are worked in and dropped again.
    """
    if points & (points - 1) or points > 4096:
        raise ValueError("points must be a power of two of at most 4096")
    bits = points.bit_length() - 1
    words = F.transform(
        F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORDS), F.lit(0)), lambda w: F.xxhash64(w)
    )
    df = df.withColumn("_omh_words", words)
    held = F.col("_omh_words")
    many = F.size(held) >= k
    kmers = F.transform(
        F.sequence(F.lit(0), F.size(held) - k),
        lambda i: _packed(F.xxhash64(*[F.get(held, i + j) for j in range(k)]), i),
    )
    short = F.array(_packed(F.xxhash64(held, F.lit(k)), F.lit(0)))
    df = df.withColumn("_omh_sorted", F.sort_array(F.when(many, kmers).otherwise(short)))

    # Equal k-mers lie side by side, in text order: their numbers count up within each run.
    ordered = F.col("_omh_sorted")
    df = df.withColumn("_omh_runs", F.concat(_run_starts(ordered), F.array(F.size(ordered))))
    runs = F.col("_omh_runs")
    numbers = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.size(runs) - 2),
            lambda r: F.sequence(F.lit(0), F.get(runs, r + 1) - F.get(runs, r) - 1),
        )
    )
    # Arrays meet outside the lambdas: one read only inside a lambda would be worked out again for every element.
    low = F.lit((1 << PLACE_BITS) - 1)
    numbered = F.zip_with(
        ordered,
        numbers,
        lambda v, number: _packed(F.xxhash64(F.shiftright(v, PLACE_BITS), number), v.bitwiseAND(low)),
    )
    df = df.withColumn("_omh_ring", F.sort_array(numbered))

    # Where the ring first reaches each point: arcs that hold a k-mer are found in one pass, the others take the next.
    ring = F.col("_omh_ring")
    half = points // 2
    arc = lambda v: F.shiftright(v, 64 - bits) + half
    starts = F.filter(
        F.sequence(F.lit(0), F.size(ring) - 1),
        lambda i: (i == 0) | (arc(F.get(ring, i)) != arc(F.get(ring, i - 1))),
    )
    df = df.withColumn("_omh_arcs", F.map_from_entries(F.transform(starts, lambda i: F.struct(arc(F.get(ring, i)), i))))
    df = df.withColumn("_omh_filled", F.array_sort(F.map_keys("_omh_arcs")))
    filled, arcs = F.col("_omh_filled"), F.col("_omh_arcs")
    reach = F.transform(
        F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long")),
        lambda p: F.coalesce(
            F.element_at(arcs, p),
            F.element_at(arcs, F.get(F.filter(filled, lambda a: a > p), F.lit(0))),
            F.lit(0),
        ),
    )
    df = df.withColumn("_omh_reach", F.when(F.size(filled) > 0, reach))
    # The k-mers turned round, position above hash, so that a primitive sort puts them into text order.
    under = 63 - PLACE_BITS
    turned = F.transform(
        ring,
        lambda v: F.shiftleft(v.bitwiseAND(low), under).bitwiseOR(
            F.shiftright(v, PLACE_BITS).bitwiseAND(F.lit((1 << under) - 1))
        ),
    )
    df = df.withColumn("_omh_turned", turned)
    held, reach = F.col("_omh_turned"), F.col("_omh_reach")
    size = F.size(held)

    def tuple_hash(start: Column) -> Column:
        """Hash of the picked k-mers in text order; a text with fewer k-mers repeats them."""
        picked = F.array(*[F.get(held, (start + j) % size) for j in range(picks)])
        in_order = F.transform(F.sort_array(picked), lambda v: v.bitwiseAND(F.lit((1 << under) - 1)))
        return F.lpad(F.hex(F.xxhash64(in_order).bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")

    hashes = F.when(F.size(reach) > 0, F.transform(reach, tuple_hash))
    df = df.withColumn(into, F.lower(F.array_join(hashes, "")))
    return df.drop(*[c for c in df.columns if c.startswith("_omh")])


def likeness(left: Column, right: Column, points: int = 64) -> Column:
    """Share of equal tuples of two fingerprints, 0 to 1."""
    same = [(F.substring(left, 8 * j + 1, 8) == F.substring(right, 8 * j + 1, 8)).cast("int") for j in range(points)]
    return reduce(Column.__add__, same) / F.lit(float(points))


def with_next(docs: DataFrame, runs: int | None = None) -> DataFrame:
    """Add the following row's columns, descending by ``doc_id`` and back to the first behind the last.

    ``docs`` has ``doc_id`` and other columns; each gets a ``next_`` twin. Rows
    without an id stand last; rows of one id stand by their ``text``. Ids are cut
    into runs of about as many rows; the first rows of a run are also sent to the
    run before it, so one shuffle shows every row its successor and no task sees
    all rows. Only the cut points and one id a run pass through the driver: their
    number is four times the shuffle width, whatever the table's size.
    """
    spark = docs.sparkSession
    wanted = runs or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = cut_points(docs, "doc_id", wanted)
    placed = docs.withColumn("_run", run_of(F.col("doc_id"), cuts)).withColumn("_guest", F.lit(0))
    # Rows without an id follow the smallest id: their run comes after run 0 on the way down.
    rank = F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("_run"))
    placed = placed.withColumn("_run", rank)
    heads = [tuple(r) for r in placed.groupBy("_run").agg(F.max("doc_id").alias("head")).collect()]
    heads.sort(reverse=True)
    if not heads:
        heads = [(0, None)]
    pairs = [(heads[i][0], *heads[(i + 1) % len(heads)]) for i in range(len(heads))]
    table = F.broadcast(
        spark.createDataFrame(pairs, "before int, run int, head long").select("before", F.col("run").alias("_run"), "head")
    )
    guests = placed.join(table, ["_run"]).where(F.col("doc_id").eqNullSafe(F.col("head")))
    if heads[-1][0] == -1:
        guests = guests.where((F.col("_run") != -1) | F.col("doc_id").isNull())
    guests = guests.select(*docs.columns, F.col("before").alias("_run"), F.lit(1).alias("_guest"))
    rows = placed.select(*docs.columns, "_run", "_guest").unionByName(guests)
    order = Window.partitionBy("_run").orderBy("_guest", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())
    shown = rows.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in docs.columns])
    return shown.where("_guest = 0").drop("_run", "_guest")


def edited(text: Column, after: Column) -> Column:
    """The text with its last half replaced by as much of the beginning of the next one (or all of it)."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(after, F.lit(1), half))


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited twin, and how alike they are.

    Reads ``doc_id`` (long) and ``text``; other columns are ignored. A null text is
    read as the empty one. One row for each row of the input; repeated rows are
    each other's neighbours. A lone row is its own successor.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(fingerprinted(own, "text", "fingerprint"))
    rows = rows.withColumn("edited", edited(F.col("text"), F.coalesce("next_text", F.lit(""))))
    rows = fingerprinted(rows, "edited", "edited_fingerprint")
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
