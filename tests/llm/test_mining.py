"""Hard negatives, shared lines and periodic runs against plain readings, and their edge cases."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from advertide.llm import linededup, negatives, periodic
from tests.llm import brute

SF = "/root/testdata/sf0.001"
LONG = "long tail " * 30_000
ODD = [
    (1, "one two three four five", None, 7),
    (1, "one two three four five", None, 7),
    (None, None, "b", None),
    (None, "x", "b", 1),
    (2, "", "a", 1),
    (3, LONG, "a", 1),
    (4, "ONE two Three four five", "é", 1),
    (5, " \t\n", "", 1),
    (6, "  one two three four five\t", "a", 2),
    (None, "One two three four five", None, 0),
]
CLASHES = ("block", "shard", "hash", "mark", "last", "label", "rank", "score", "negative", "runs", "best", "_h", "_a", "copies")


@pytest.fixture(scope="module")
def odd(spark):
    frame = spark.createDataFrame(ODD, "doc_id long, text string, source string, size int")
    for name in CLASHES:
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


# 11 hard negatives


def rows_of(found):
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("block, piece", [(16384, 4096), (7, 2)])
def test_negatives_with_ties_repeats_and_gaps(spark, monkeypatch, block, piece):
    monkeypatch.setattr(negatives, "BLOCK_VECTORS", block)
    monkeypatch.setattr(negatives, "SLICE_ANCHORS", piece)
    rng = random.Random(4)
    rows = [(i, i % 3, [float(rng.randint(-2, 3)), float(rng.randint(0, 2)), 0.5]) for i in range(160)]
    rows += [rows[7], rows[7], rows[8], rows[50], (-50, 1, [1.0, 1.0, 1.0]), (100, 0, [2.0, 0.0, 0.0]), (300, 1, [0.0] * 3)]
    unusable = [(200, 1, None), (250, None, [1.0]), (201, 1, [float("nan")]), (202, 1, [1.0, float("inf")]), (203, 1, [None]), (None, 1, [9.0])]
    frame = spark.createDataFrame(rows + unusable, "vec_id long, label int, embedding array<float>")
    for name in ("score", "copies", "block", "slice", "terms", "anchor_id"):
        frame = frame.withColumn(name, F.lit("clash"))
    whole = [(i, label, [int(np.floor(256 * x)) for x in v]) for i, label, v in rows]
    got = rows_of(negatives.mined(frame))
    assert got == brute.hard_negatives(whole) and any(r[4] == 0 for r in got)
    assert rows_of(negatives.mined(frame, 10, 2, 4, 20, 100)) == brute.hard_negatives(whole, 10, 2, 4, 20, 100)


def test_negatives_of_few_and_no_rows(spark):
    frame = spark.createDataFrame([(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.9]), (50, 3, [])], "vec_id long, label int, embedding array<float>")
    assert rows_of(negatives.mined(frame)) == [(0, 1, 1, 2, 65536, 58880)]
    assert negatives.mined(frame.limit(0)).count() == 0 and negatives.mined(frame.where("vec_id = 1")).count() == 0


def test_a_row_repeated_without_end_is_one_row_on_the_way(spark):
    hot = spark.range(30_000).selectExpr("3L vec_id", "1 label", "array(1f, 2f) embedding")
    rest = spark.createDataFrame([(0, 1, [1.0, 1.0]), (4, 2, [1.0, 1.5])], "vec_id long, label int, embedding array<float>")
    assert negatives.labelled(hot.union(rest)).count() == 3
    found = rows_of(negatives.mined(hot.union(rest)))
    assert found == [(0, 3, 1, 4, 196608, 163840)] * 5


def test_large_numbers_are_scored_exactly(spark):
    rows = [(0, 1, [2.0**20, 1.0]), (1, 1, [2.0**20, 2.0]), (2, 1, [2.0**20, 1.0]), (3, 2, [2.0**20 * 0.75, 3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    whole = [(i, label, [int(256 * x) for x in v]) for i, label, v in rows]
    assert rows_of(negatives.mined(frame)) == brute.hard_negatives(whole)


def test_keys_sort_as_their_numbers():
    rng = random.Random(2)
    rows = [(rng.randint(-3, 3) * 50, rng.choice([-(2**40), -1, 0, 1, 2**40]), rng.random() < 0.5, rng.randint(-9, 9)) for _ in range(400)]
    by_bytes = [negatives.unpacked(k) for k in sorted(negatives.packed(*r) for r in rows)]
    assert by_bytes == sorted(rows, key=lambda r: (r[0], -r[1], r[2], r[3]))


def test_labels_move_on(spark):
    frame = spark.createDataFrame([(7, 9), (14, 0), (8, 3), (None, 4), (21, None)], "vec_id long, label int")
    assert [r.label for r in negatives.relabelled(frame).collect()] == [0, 1, 3, 4, None]


# 12 shared lines


@pytest.mark.parametrize("block_bytes, shard_bytes", [(1 << 22, 1 << 24), (4000, 3000)])
def test_lines_of_documents(spark, texts, block_bytes, shard_bytes):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = linededup.without_shared_lines(docs, block_bytes=block_bytes, shard_bytes=shard_bytes)
    assert rows_of(got) == sorted(brute.shared_lines(texts.items()))


def test_lines_of_odd_rows(spark, odd):
    plain = [(i, t) for i, t, *_ in ODD]
    for min_docs, least in ((3, 20), (2, 1), (1, 0)):
        for block_bytes in (1 << 22, 50):
            got = linededup.without_shared_lines(odd, min_docs, least, block_bytes, 64)
            assert sorted(map(tuple, got.collect()), key=str) == sorted(brute.shared_lines(plain, min_docs, least), key=str)
    assert linededup.without_shared_lines(odd.limit(0)).count() == 0
    assert linededup.line_report(odd).columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]


def test_a_line_is_counted_by_documents_and_code_points(spark):
    short, enough = "é" * 19, "É" * 20
    rows = [(i, f"{short}\n {enough}\t\n{enough}\r\nown {i}") for i in range(4)] + [(9, f"{enough}\n{enough}")]
    rows += [(20, "said twice by one document"), (20, "other text\nsaid twice by one document"), (21, "Said Twice by one document")]
    got = rows_of(linededup.without_shared_lines(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=20))
    assert got == sorted(brute.shared_lines(rows)) and {r[0]: r[2] for r in got} == {0: 2, 1: 2, 2: 2, 3: 2, 9: 0, 20: 0, 21: 0}


@pytest.mark.parametrize("size", [0, 1, 2, 1000, 50_000])
def test_perfect_hash_is_perfect_and_minimal(size):
    rng = np.random.default_rng(size)
    keys = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
    keys, marks = np.repeat(keys, 2), np.tile(np.array([1, 2], np.uint32), len(keys))
    built = linededup.PerfectHash.over(keys, marks)
    stored = linededup.PerfectHash(built.sizes, built.bits)
    assert sorted(stored.slots(keys, marks).tolist()) == list(range(len(keys)))
    assert (built.slots(keys, marks + np.uint32(7)) < len(keys)).all()
    assert size < 1000 or len(built.bits) * 8 < 5 * len(keys)


def test_an_index_answers_for_other_documents(spark):
    docs = spark.createDataFrame([(i, f"a line that they all hold\nown line of document {i}") for i in range(5)], "doc_id long, text string")
    _, asked = linededup.asked_keys(docs, 2, 3)
    index = linededup.line_index(asked).collect()
    assert {r.shard for r in index} <= {0, 1, 2} and sum(len(r.marks) for r in index) == 4 * 6
    assert sorted(c for r in index for c in np.frombuffer(r.counts, "<u4").tolist()) == [1, 1, 1, 1, 1, 3]


# 13 periodic runs


def test_runs_of_random_words():
    rng = random.Random(6)
    for _ in range(600):
        n, k = rng.randint(0, 60), rng.randint(1, 4)
        words = [rng.randrange(k) for _ in range(n)]
        if n > 4 and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randint(1, 8)
            for i in range(a, rng.randint(a, n)):
                words[i] = words[a + (i - a) % p]
        assert periodic.runs_in(words) == brute.periodic(words)
        assert periodic.runs_in(words, 2, 2) == brute.periodic(words, 2, 2)


def test_extensions_are_common_prefixes():
    rng = random.Random(8)
    words = [rng.randrange(2) for _ in range(200)]
    longest = periodic.SuffixTree(words).extensions()
    for _ in range(500):
        i, j = rng.sample(range(201), 2)
        n = 0
        while max(i, j) + n < 200 and words[i + n] == words[j + n]:
            n += 1
        assert longest.agree(np.array([i]), np.array([j]))[0] == n


def test_stretches_hold_every_run():
    rng = random.Random(9)
    texts = []
    for _ in range(400):
        n, k = rng.randint(0, 90), rng.choice([1, 2, 3, 30])
        words = [f"w{rng.randrange(k)}" for _ in range(n)]
        if n > 4 and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randint(1, 20)
            for i in range(a, rng.randint(a, n)):
                words[i] = words[a + (i - a) % p]
        texts.append("  ".join(words).encode())
    for times, least in ((4, 6), (4, 40), (6, 1), (2, 2)):
        for text, (words, runs) in zip(texts, periodic.text_runs(texts, times, least)):
            assert words == text.split() and runs == brute.periodic(words, times, least)


def test_report_of_documents(spark, texts):
    got = {r.doc_id: r for r in periodic.run_report(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    seen = Counter()
    for doc_id, text in texts.items():
        words, h = brute.WORD.findall(text or ""), zlib.crc32(str(doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
        runs = brute.periodic(words)
        gone = {i for s, l, q in runs for i in range(s + q, s + l)}
        best = min(((-l, s, q) for s, l, q in runs), default=None)
        want = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
        r = got[doc_id]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *want)
        assert r.runs_sha256 == brute.sha("".join(f"{s},{l},{q}\n" for s, l, q in runs))
        assert r.collapsed_sha256 == brute.sha(" ".join(w for i, w in enumerate(words) if i not in gone))
        seen[bool(runs)] += 1
    assert seen[True] > 5


def test_runs_of_odd_rows(odd):
    rows = [(r.doc_id, [tuple(s) for s in r.runs], r.kept_text) for r in periodic.periodic_runs(odd).collect()]
    assert sorted((i, s) for i, s, _ in rows if s) == [(3, [(0, 60_000, 2)])]
    assert {t for i, _, t in rows if i == 3} == {"long tail"} and {t for i, _, t in rows if i in (2, 5)} == {""}
    report = periodic.run_report(odd).collect()
    assert len(report) == len(ODD) and all(r.runs_sha256 and r.collapsed_sha256 for r in report)
    assert [r.start for r in report if r.n_runs == 0] == [None] * sum(r.n_runs == 0 for r in report)
    assert periodic.run_report(odd.limit(0)).count() == 0
