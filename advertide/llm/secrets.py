"""Secrets in texts, told apart by who owns them, in DataFrame expressions only.

Patterns give candidate spans. Over the whole corpus every candidate value's hash
is counted by distinct repositories (documents) and owners (sources): a value that
many owners hold is a copied example, one that stays with few is live-looking.
Long mixed tokens without a telling context are candidates too; those become
spans only where their ownership says that they are live-looking.

Positions are running sums of the lengths of matches and of the gaps between them,
in code points. Texts never move: what is staged and joined is spans and hashes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advertide.session import stage

# Kind, pattern, group whose text is the value, least characters of the value.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
ADDED = ("token", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}", 0, 20)
NAMES = [k[0] for k in KINDS] + [ADDED[0]]
# A value held by more sources than this is a copied example.
MOST_OWNERS = 2
SPAN = "array<struct<start:int,kind:int,end:int,hash:bigint>>"
STEP = 256


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _with_running(df: DataFrame, lengths: str, into: str) -> DataFrame:
    """Add the running sums of an array column, in two levels: a sum costs at most STEP steps for each element."""
    held = F.col(lengths)
    sums = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(held) - 1) / STEP).cast("int")), lambda b: _total(F.slice(held, b * STEP + 1, STEP))
    )
    df = df.withColumn("_sec_sums", F.when(F.size(held) > 0, sums).otherwise(F.array().cast("array<int>")))
    sums = F.col("_sec_sums")
    before = F.transform(sums, lambda x, b: _total(F.slice(sums, F.lit(1), b)))
    df = df.withColumn("_sec_before", before)
    before = F.col("_sec_before")
    running = F.transform(
        held,
        lambda x, i: F.get(before, F.floor(i / STEP).cast("int"))
        + _total(F.slice(held, F.floor(i / STEP).cast("int") * STEP + 1, i % STEP + 1)),
    )
    none = F.array().cast("array<int>")
    return df.withColumn(into, F.when(F.size(before) > 0, running).otherwise(none)).drop("_sec_sums", "_sec_before")


def _with_spans(df: DataFrame, number: int, kind: tuple, into: str) -> DataFrame:
    """Add the spans of one kind's matches whose value is long enough."""
    _, pattern, group, least = kind
    text, hit = F.col("_sec_text"), F.col("_sec_text").rlike(pattern)
    none = F.array().cast("array<string>")
    df = df.withColumn("_sec_hits", F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    found = F.size("_sec_hits") > 0
    df = df.withColumn("_sec_gaps", F.when(found, F.split(text, pattern, -1)).otherwise(none))
    values = F.when(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(none) if group else F.col("_sec_hits")
    df = df.withColumn("_sec_values", values)
    hits, gaps = F.col("_sec_hits"), F.col("_sec_gaps")
    # A match begins behind its gap and everything before; the last gap has no match.
    steps = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(hits)),
        F.concat(F.array(F.lit("")), F.slice(hits, F.lit(1), F.greatest(F.size(hits) - 1, F.lit(0)))),
        lambda gap, match: F.length(gap) + F.coalesce(F.length(match), F.lit(0)),
    )
    df = df.withColumn("_sec_steps", F.when(found, steps).otherwise(F.array().cast("array<int>")))
    df = _with_running(df, "_sec_steps", "_sec_starts")
    spans = F.zip_with(
        F.arrays_zip("_sec_starts", "_sec_hits"),
        F.col("_sec_values"),
        lambda at, value: F.struct(
            at["_sec_starts"].alias("start"),
            F.lit(number).alias("kind"),
            (at["_sec_starts"] + F.length(at["_sec_hits"])).alias("end"),
            F.when(F.length(value) >= least, F.xxhash64(value)).alias("hash"),
        ),
    )
    if kind is ADDED:
        mixed = lambda v: v.rlike("[0-9]") & v.rlike("[A-Z]") & v.rlike("[a-z]")
        kept = F.filter(spans, lambda s, i: s["hash"].isNotNull() & mixed(F.get(F.col("_sec_values"), i)))
    else:
        kept = F.filter(spans, lambda s: s["hash"].isNotNull())
    kept = F.when(F.size("_sec_values") > 0, kept).otherwise(F.array().cast(SPAN))
    df = df.withColumn(into, kept.cast(SPAN))
    return df.drop("_sec_hits", "_sec_gaps", "_sec_values", "_sec_steps", "_sec_starts")


def with_candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_sec_base`` and ``_sec_added``, arrays of spans by start, and ``_sec_key``, the row's identity."""
    df = docs.withColumn("_sec_text", F.coalesce(F.col("text"), F.lit("")))
    for number, kind in enumerate(KINDS):
        df = _with_spans(df, number, kind, f"_sec_{kind[0]}")
    df = _with_spans(df, len(KINDS), ADDED, "_sec_token")
    base = F.array_sort(F.concat(*[F.col(f"_sec_{k[0]}") for k in KINDS]))
    df = df.withColumn("_sec_base", base)
    apart = F.filter(
        "_sec_token",
        lambda t: ~F.exists("_sec_base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])),
    )
    df = df.withColumn("_sec_added", apart).withColumn("_sec_key", F.xxhash64("doc_id", "source", "_sec_text"))
    return df.drop("_sec_text", *[f"_sec_{n}" for n in NAMES])


def ownership(found: DataFrame, most_owners: int = MOST_OWNERS) -> DataFrame:
    """``hash, repositories, owners, live`` of every candidate value of the corpus.

    Counted from distinct (value, source, document) rows, so a value that everybody
    copies is a sum of partial counts, not one large group.
    """
    spans = F.concat("_sec_base", "_sec_added")
    each = found.select("doc_id", "source", F.explode(F.array_distinct(F.transform(spans, lambda s: s["hash"]))).alias("hash"))
    by_owner = each.distinct().groupBy("hash", "source").agg(F.count("*").alias("repositories"))
    counted = by_owner.groupBy("hash").agg(F.sum("repositories").alias("repositories"), F.count("*").alias("owners"))
    return counted.withColumn("live", F.col("owners") <= most_owners)


def _live(found: DataFrame, most_owners: int) -> DataFrame:
    """By row key: the hashes in it that are live-looking."""
    spans = F.concat("_sec_base", "_sec_added")
    each = found.select("_sec_key", F.explode(F.transform(spans, lambda s: s["hash"])).alias("hash")).distinct()
    live = each.join(ownership(found, most_owners).where("live"), "hash")
    return live.groupBy("_sec_key").agg(F.collect_set("hash").alias("_sec_live"))


def _found(docs: DataFrame) -> DataFrame:
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    return stage(with_candidates(own).drop("text"), "secret-spans")


def secret_report(docs: DataFrame, most_owners: int = MOST_OWNERS) -> DataFrame:
    """Spans of every row of ``docs``: counts of the base kinds, a digest of them, and all spans in order.

    A null text is the empty one; a null source is an owner of its own. ``n_live`` and
    ``n_copied`` count spans by ownership.
    """
    found = _found(docs)
    rows = found.join(_live(found.where("size(_sec_base) + size(_sec_added) > 0"), most_owners), "_sec_key", "left")
    live = F.coalesce("_sec_live", F.array().cast("array<bigint>"))
    rows = rows.withColumn("_sec_live", live)
    added = F.filter("_sec_added", lambda s: F.array_contains("_sec_live", s["hash"]))
    rows = rows.withColumn("_sec_all", F.array_sort(F.concat("_sec_base", added)))
    name = lambda k: F.get(F.array(*[F.lit(n) for n in NAMES]), k)
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"])), ",")
    count = lambda n: F.size(F.filter("_sec_base", lambda s: s["kind"] == n)).cast("long")
    n_live = F.size(F.filter("_sec_all", lambda s: F.array_contains("_sec_live", s["hash"])))
    return rows.select(
        "doc_id",
        *[count(n).alias(f"n_{k[0]}") for n, k in enumerate(KINDS)],
        F.sha2(listed("_sec_base").cast("binary"), 256).alias("base_sha256"),
        listed("_sec_all").alias("spans"),
        n_live.cast("long").alias("n_live"),
        (F.size("_sec_all") - n_live).cast("long").alias("n_copied"),
    )


def redacted(docs: DataFrame, mark: str = "[secret]", most_owners: int = MOST_OWNERS) -> DataFrame:
    """``docs`` with every live-looking span replaced by ``mark``; all rows and columns stay.

    Overlapping spans are one. Copied examples and clean texts are left as they are;
    ``n_chars`` follows the text where there is such a column.
    """
    names = docs.columns
    rows = with_candidates(docs.select(F.struct(*names).alias("_sec_doc"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text"))
    live = _live(_found(docs).where("size(_sec_base) + size(_sec_added) > 0"), most_owners)
    rows = rows.join(live, "_sec_key", "left")
    spans = F.filter(F.array_sort(F.concat("_sec_base", "_sec_added")), lambda s: F.array_contains("_sec_live", s["hash"]))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    text = F.col("_sec_doc.text")

    def splice(held: Column, s: Column) -> Column:
        fresh = s["start"] >= held["at"]
        gap = F.substring(text, held["at"] + 1, F.greatest(s["start"] - held["at"], F.lit(0)))
        out = F.when(fresh, F.concat(held["out"], gap, F.lit(mark))).otherwise(held["out"])
        return F.struct(out.alias("out"), F.greatest(held["at"], s["end"]).alias("at"))

    done = F.aggregate(spans, start, splice, lambda held: F.concat(held["out"], F.substring(text, held["at"] + 1, F.length(text))))
    changed = F.when(F.col("_sec_live").isNotNull() & text.isNotNull(), done).otherwise(text)
    rows = rows.withColumn("_sec_new", changed)
    new = {"text": F.col("_sec_new"), "n_chars": F.when(F.col("_sec_live").isNull(), F.col("_sec_doc.n_chars")).otherwise(F.length("_sec_new").cast("long")) if "n_chars" in names else None}
    return rows.select(*[(new[c] if c in new else F.col(f"_sec_doc.{c}")).alias(c) for c in names])
