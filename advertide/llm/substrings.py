"""Remove token windows that an earlier document already has.

Documents are dealt into blocks of consecutive ids. A block hashes all of its
windows of ``window`` words by Rabin-Karp and sends every distinct hash once, in
hash order, to the bucket of its first bits. A bucket counts in how many blocks
a hash stands and answers each block but the first with the hashes an earlier
block holds. Blocks are in id order, so that answer and the order inside the
block tell of each window whether a smaller id has it. Covered words merge into
maximal intervals, which are cut out.

A window travels as about six bytes; texts are shuffled once, by block, and
read twice from that shuffle. Windows are compared by 64-bit hashes: two
different windows agree with a probability of 2**-64.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from advertide.llm.exchange import bucket_edges, cut_points, pack, pieces_for, run_of, unpack
from advertide.llm.words import encoded, separators, sliced, windows, word_hashes

BLOCK_DOCS = 2048
RESULT = "doc_id long, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept_text string"


def _hashed(texts: list[bytes], window: int):
    """Slice by slice: the slice, word bounds of its texts, and hash, text and first word of every window."""
    blank = separators()
    for part in sliced(texts):
        hashes, bounds = word_hashes(texts[part], blank)
        yield part, bounds, *windows(hashes, bounds, window)


def _ask(window: int, bits: int):
    def ask(block: pd.DataFrame) -> pd.DataFrame:
        found = [np.unique(h) for _, _, h, _, _ in _hashed([encoded(t) for t in block["text"]], window)]
        every = np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)
        edges = bucket_edges(every, bits)
        full = np.flatnonzero(np.diff(edges))
        return pd.DataFrame(
            {
                "bucket": full.astype(np.int32),
                "block": np.full(len(full), block["block"].iloc[0], dtype=np.int32),
                "hashes": [pack(every[edges[b] : edges[b + 1]]) for b in full],
            }
        )

    return ask


def _answer(bucket: pd.DataFrame) -> pd.DataFrame:
    """To each block the hashes that a block before it holds."""
    bucket = bucket.sort_values("block")
    parts = [unpack(b) for b in bucket["hashes"]]
    every = np.concatenate(parts)
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    again = np.flatnonzero(np.concatenate([[False], ranked[1:] == ranked[:-1]]))
    hits, whose = ranked[again], owner[order][again]
    by_block = np.argsort(whose, kind="stable")
    hits, whose = hits[by_block], whose[by_block]
    blocks, starts = np.unique(whose, return_index=True)
    ends = np.append(starts[1:], len(hits))
    return pd.DataFrame(
        {
            "block": bucket["block"].to_numpy()[blocks].astype(np.int32),
            "seen": [pack(hits[s:e]) for s, e in zip(starts, ends)],
        }
    )


def _intervals(mask: np.ndarray) -> list[dict]:
    turn = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return [{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(turn == 1), np.flatnonzero(turn == -1))]


def _cut(window: int):
    def cut(texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(texts):
            return pd.DataFrame({c.split()[0]: [] for c in ("doc_id", "n_words", "n_removed", "removed", "kept_text")})
        texts = texts.sort_values("doc_id", kind="stable", na_position="last").reset_index(drop=True)
        seen = np.sort(np.concatenate([unpack(b) for b in answers["seen"]])) if len(answers) else np.empty(0, np.uint64)
        raw = [encoded(t) for t in texts["text"]]
        ids = texts["doc_id"]
        # Rows of one id are one document: only a smaller id counts. Rows without an id stand behind all others.
        rank = pd.factorize(ids, use_na_sentinel=False)[0]
        parts = list(_hashed(raw, window))
        hashes = np.concatenate([p[2] for p in parts])
        owner = np.concatenate([p[3] + p[0].start for p in parts])
        order = np.argsort(hashes, kind="stable")
        ranked = hashes[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.empty(0, bool)
        first = rank[owner[order]][new]
        repeated = np.empty(len(hashes), dtype=bool)
        repeated[order] = first[np.cumsum(new) - 1] < rank[owner[order]]
        if len(seen) and len(hashes):
            at = np.minimum(np.searchsorted(seen, hashes), len(seen) - 1)
            repeated |= seen[at] == hashes
        rows, done = [], 0
        for part, bounds, hit, _, start in parts:
            flagged = start[repeated[done : done + len(hit)]]
            done += len(hit)
            cover = np.zeros(bounds[-1] + 1, dtype=np.int32)
            np.add.at(cover, flagged, 1)
            np.add.at(cover, flagged + window, -1)
            covered = np.cumsum(cover[:-1]) > 0
            for i in range(part.start, part.stop):
                words = raw[i].split()
                mask = covered[bounds[i - part.start] : bounds[i - part.start + 1]]
                gone = int(mask.sum())
                kept = list(compress(words, ~mask)) if gone else words
                rows.append((ids[i], len(words), gone, _intervals(mask) if gone else [], b" ".join(kept).decode("utf-8", "replace")))
        out = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "removed", "kept_text"])
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    return cut


def without_repeats(docs: DataFrame, window: int = 13, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``doc_id, n_words, n_removed, removed, kept_text`` of every row of ``docs``.

    ``removed`` holds maximal intervals of word numbers, ``kept_text`` the other words
    joined by one space. A null text has no words. Rows of one id are one document
    and take nothing from each other; rows without an id come last, as one.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = pieces_for(own.count(), block_docs)
    bits = max(4, (blocks - 1).bit_length())
    own = own.withColumn("block", run_of(F.col("doc_id"), cut_points(own, "doc_id", blocks)).cast("int"))
    asked = own.groupBy("block").applyInPandas(_ask(window, bits), "bucket int, block int, hashes binary")
    answers = asked.groupBy("bucket").applyInPandas(_answer, "block int, seen binary")
    return own.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_cut(window), RESULT)


def removal_report(docs: DataFrame) -> DataFrame:
    found = without_repeats(docs)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
