"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all other text of the training
folds is unlabelled, toxic or not. With the class prior ``pi`` the risk of a
scorer is ``pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))``: the unlabelled risk,
corrected for the toxic share in it, and held at zero where it would turn
negative (there the step goes the other way). Linear scorers over word presence
are trained with numpy, one in each of a few tasks on its own part of the
unlabelled sample; a document's score is the mean of their probabilities.

The training sample is bounded by ``most_positive`` and ``most_unlabelled`` rows
(chosen by a hash of the id, so that reruns agree); the prior is counted over all
training labels, and every document is scored on its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advertide.llm.words import BLANKS, encoded, separators, sliced, word_hashes

FEATURE_BITS = 20
# Words for scoring end at any ASCII byte that is neither letter nor digit.
_EDGES = bytes(b for b in range(128) if not chr(b).isalnum()) + BLANKS
FOLD = 4
HELD_OUT = 2
THRESHOLD = 0.3
MODEL = "member int, slots binary, weights binary, bias double"


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLD


def features(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The distinct hashed words of each text, lower-cased."""
    blank = separators(_EDGES)
    for part in sliced(texts):
        hashes, bounds = word_hashes(texts[part], blank, lower=True)
        slots = (hashes >> np.uint64(64 - FEATURE_BITS)).astype(np.int32)
        for i in range(part.stop - part.start):
            yield np.unique(slots[bounds[i] : bounds[i + 1]])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train_nnpu(
    rows: list[np.ndarray], positive: np.ndarray, prior: float, least: int = 4, evidence: float = 4.0, steps: int = 200, rate: float = 0.1, decay: float = 1e-4
) -> tuple[np.ndarray, np.ndarray, float]:
    """Slots, their weights and the bias of a linear scorer under the non-negative risk with logistic loss.

    A slot has a weight if at least ``least`` rows hold it and its shares among positives
    and unlabelled differ by ``evidence`` standard errors. Full-batch Adam from zero.
    """
    lengths = np.array([len(r) for r in rows])
    flat = np.concatenate(rows) if len(rows) else np.empty(0, np.int32)
    slots, column, counts = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(rows)), lengths)
    n_p, n_u = max(positive.sum(), 1), max((~positive).sum(), 1)
    in_p = np.bincount(column, weights=positive[row].astype(float), minlength=len(slots))
    share = counts / len(rows)
    error = np.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u)) + 1e-12
    kept = (counts >= least) & (np.abs(in_p / n_p - (counts - in_p) / n_u) >= evidence * error)
    number = np.cumsum(kept) - 1
    use = kept[column]
    row, column, slots = row[use], number[column[use]], slots[kept]
    w = np.zeros(len(slots) + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)
    w[-1] = np.log(prior / (1 - prior))
    for step in range(1, steps + 1):
        g = np.bincount(row, weights=w[column], minlength=len(rows)) + w[-1]
        p = _sigmoid(g)
        loss_minus = np.logaddexp(0, g)
        negative_risk = loss_minus[~positive].sum() / n_u - prior * loss_minus[positive].sum() / n_p
        # Slopes by score: log(1 + e^-g) for the positives as positives, log(1 + e^g) for the rest.
        plus = np.where(positive, prior * (p - 1) / n_p, 0.0)
        minus = np.where(positive, -prior * p / n_p, p / n_u)
        slope = plus + minus if negative_risk >= 0 else -minus
        gradient = np.append(np.bincount(column, weights=slope[row], minlength=len(slots)), slope.sum())
        gradient[:-1] += decay * w[:-1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-10)
    return slots, w[:-1], float(w[-1])


def training_sample(docs: DataFrame, labels: DataFrame, most_positive: int, most_unlabelled: int) -> tuple[DataFrame, float]:
    """``doc_id, text, positive`` of the training folds, and the toxic share of their labels.

    Only ids are ranked; the chosen ones, a bounded list, are looked up in one scan of the texts.
    """
    known = labels.where((fold(F.col("doc_id")) != HELD_OUT) & F.col("toxic").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    toxic, seen = known.agg(F.sum("toxic"), F.count("*")).first()
    prior = min(max((toxic or 0) / seen, 0.001), 0.5) if seen else 0.05
    order = F.xxhash64("doc_id", F.lit("sample"))
    positives = known.where("toxic = 1").orderBy(order, "doc_id").limit(most_positive).select("doc_id", F.lit(True).alias("positive"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(fold(F.col("doc_id")) != HELD_OUT)
    unlabelled = ids.orderBy(order, "doc_id").limit(most_unlabelled).distinct().select("doc_id", F.lit(False).alias("positive"))
    chosen = F.broadcast(positives.union(unlabelled))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id"), prior


def fit(docs: DataFrame, labels: DataFrame, members: int = 3, most_positive: int = 4000, most_unlabelled: int = 12000) -> list[dict]:
    """Train ``members`` scorers; each is a row of ``MODEL``, together a few MB at most.

    Every member sees all sampled positives and its own part of the unlabelled
    sample. Without a confirmed toxic document there is nothing to learn: the list is
    empty.
    """
    sample, prior = training_sample(docs, labels, most_positive, most_unlabelled)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = features([encoded(t) for t in batch["text"]])
            batch["slots"] = [f.astype("<i4").tobytes() for f in found]
            yield batch.drop(columns="text")

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "positive", "slots"], kind="stable")
        positive = rows["positive"].to_numpy(dtype=bool)
        if not positive.any() or positive.all():
            return pd.DataFrame({c.split()[0]: [] for c in MODEL.split(", ")})
        slots, weights, bias = train_nnpu([np.frombuffer(s, "<i4") for s in rows["slots"]], positive, prior)
        return pd.DataFrame(
            {"member": [int(rows["member"].iloc[0])], "slots": [slots.astype("<i4").tobytes()], "weights": [weights.astype("<f4").tobytes()], "bias": [bias]}
        )

    read_rows = sample.mapInPandas(read, "doc_id long, positive boolean, slots binary")
    share = F.array(F.pmod(F.xxhash64("doc_id", F.lit("member")), F.lit(members)).cast("int"))
    every = F.array(*[F.lit(m) for m in range(members)])
    dealt = read_rows.withColumn("member", F.explode(F.when(F.col("positive"), every).otherwise(share)))
    found = dealt.groupBy("member").applyInPandas(train, MODEL).collect()
    return sorted((r.asDict() for r in found), key=lambda r: r["member"])


def scorer(model: list[dict]):
    """A function of a text column giving the toxicity in 0 … 1; a null is the empty text."""
    tables = []
    for member in model:
        weights = np.zeros(1 << FEATURE_BITS, dtype=np.float32)
        weights[np.frombuffer(member["slots"], "<i4")] = np.frombuffer(member["weights"], "<f4")
        tables.append((np.frombuffer(member["slots"], "<i4"), np.frombuffer(member["weights"], "<f4"), member["bias"]))

    def dense(table):
        weights = np.zeros(1 << FEATURE_BITS, dtype=np.float32)
        weights[table[0]] = table[1]
        return weights, table[2]

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ready = [dense(t) for t in tables]
        for texts in batches:
            out = np.zeros(len(texts))
            for i, slots in enumerate(features([encoded(t) for t in texts])):
                if ready:
                    out[i] = np.mean([_sigmoid(float(w[slots].sum(dtype=np.float64)) + b) for w, b in ready])
            yield pd.Series(out)

    return score


def scored(docs: DataFrame, labels: DataFrame, **sizes) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Labels of the held-out fold are never read. A row without an id is in no fold. A
    null or empty text is scored like any text, by the bias alone; without any
    confirmed toxic document every score is 0.
    """
    score = scorer(fit(docs, labels, **sizes))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(F.col("text")).alias("score"))
    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, **sizes) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    score = scorer(fit(docs, labels, **sizes))
    rows = docs.select(F.struct(*docs.columns).alias("doc"), score(F.col("text")).alias("score"))
    return rows.where(F.col("score") < THRESHOLD).select("doc.*")
