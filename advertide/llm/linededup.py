"""Drop lines that many documents share, by probing a sharded minimal perfect hash.

1. *Keys.* A line's key is the line without blanks at both ends and in lower
   case. Blocks of documents hash their keys to 96 bits (64 place a key, 32 are
   its fingerprint) and send every distinct key once to the shard of its hash,
   with as many document ids as the question "in at least so many?" needs.
2. *Index.* A shard builds a minimal perfect hash over its distinct keys: levels
   of bits in which a key that is alone in its place stays, and the others go on
   to the next level. A key's number among the set bits is its slot in three
   compact arrays: fingerprint, number of documents, largest document id. A
   shard is one row of the index, so the index can be written and probed again.
3. *Probe.* A block's keys look up their slot in the shard, compare the
   fingerprint and read the arrays; no lines are joined with lines. Only keys that
   lose lines go back to the block, once a block, and its documents drop them.

A line that every document holds leaves a block a few times, not once a
document. Blocks are dealt by a hash of id and text, counted in bytes, not rows.
Two different keys are taken for one with a probability of 2**-96.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from advertide.llm.exchange import pieces_for
from advertide.llm.words import BLANKS, encoded, mix

BLOCK_BYTES, SHARD_BYTES = 1 << 22, 1 << 22
# Stands for a missing id: one document before all others.
NO_ID = np.iinfo(np.int64).min
ASKED = "block int, shard int, hash long, mark int, doc_id long"
INDEX = "shard int, sizes array<long>, bits binary, marks binary, counts binary, last binary"
ANSWER = "block int, hash long, mark int, last long"
RESULT = "doc_id long, n_lines long, n_dropped long, kept_text string"


class PerfectHash:
    """A minimal perfect hash of distinct (hash, mark) keys, as levels of bits with running counts.

    A level has two places a key. A key that is alone in its place sets the bit and
    stays; the others try again in the next level, which hashes anew.
    """

    def __init__(self, sizes: list[int], bits: bytes):
        self.sizes = sizes
        words = np.frombuffer(bits, dtype="<u8")
        edges = np.cumsum([0] + [s // 64 for s in sizes])
        self.levels = [words[a:b] for a, b in zip(edges, edges[1:])]
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        self.before = [before[a:b] for a, b in zip(edges, edges[1:])]

    @staticmethod
    def place(hashes: np.ndarray, marks: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = mix(marks.astype(np.uint64) + np.uint64((level + 1) << 32))
        return (mix(hashes ^ salt) % np.uint64(size)).astype(np.int64)

    @classmethod
    def over(cls, hashes: np.ndarray, marks: np.ndarray) -> PerfectHash:
        sizes, words = [], []
        while len(hashes):
            size = 64 * -(-2 * len(hashes) // 64)
            at = cls.place(hashes, marks, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            stays = alone[at]
            hashes, marks = hashes[~stays], marks[~stays]
        return cls(sizes, b"".join(w.tobytes() for w in words))

    @property
    def bits(self) -> bytes:
        return b"".join(w.tobytes() for w in self.levels)

    def slots(self, hashes: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Each key's slot, from 0 and without gaps over the keys it was built from; -1 where no level has it."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        left = np.arange(len(hashes))
        for level, (size, words, before) in enumerate(zip(self.sizes, self.levels, self.before)):
            at = self.place(hashes[left], marks[left], level, size)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            found = (word >> bit) & np.uint64(1) == 1
            lower = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[found]] = (before[at >> 6] + lower)[found]
            left = left[~found]
            if not len(left):
                break
        return out


def key_of(line: bytes, least: int) -> bytes | None:
    """The line's key; None where it has fewer than ``least`` code points."""
    key = line.strip(BLANKS).lower()
    if len(key) < least or (len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least):
        return None
    return key


def _digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)[:12]


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), dtype=[("hash", "<u8"), ("mark", "<u4")])
    return np.ascontiguousarray(both["hash"]), np.ascontiguousarray(both["mark"])


def _ids(doc_ids: pd.Series) -> np.ndarray:
    return np.array([NO_ID if pd.isna(i) else i for i in doc_ids], dtype=np.int64)


def _ask(shards: int, min_docs: int, least: int):
    def ask(block: pd.DataFrame) -> pd.DataFrame:
        holders: dict[bytes, list[int]] = {}
        # Largest ids first: a key's first holders here are those that decide.
        ids = _ids(block["doc_id"])
        order = np.argsort(ids, kind="stable")[::-1]
        texts = block["text"].tolist()
        for i in order:
            doc_id = int(ids[i])
            for line in encoded(texts[i]).split(b"\n"):
                key = key_of(line, least)
                if key is None:
                    continue
                held = holders.setdefault(_digest(key), [])
                if len(held) < min_docs and (not held or held[-1] != doc_id):
                    held.append(doc_id)
        hashes, marks = _halves(list(holders))
        counts = np.fromiter((len(h) for h in holders.values()), dtype=np.int64, count=len(holders))
        return pd.DataFrame(
            {
                "block": np.full(counts.sum(), block["block"].iloc[0], dtype=np.int32),
                "shard": np.repeat((hashes % np.uint64(shards)).astype(np.int32), counts),
                "hash": np.repeat(hashes.view(np.int64), counts),
                "mark": np.repeat(marks.view(np.int32), counts),
                "doc_id": np.fromiter((i for h in holders.values() for i in h), dtype=np.int64, count=counts.sum()),
            }
        )

    return ask


def _new(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    changed = np.zeros(len(columns[0]), dtype=bool)
    for c in columns:
        changed[1:] |= c[1:] != c[:-1]
    changed[:1] = True
    return changed


def _index(min_docs: int):
    def index(shard: pd.DataFrame) -> pd.DataFrame:
        hashes = shard["hash"].to_numpy().view(np.uint64)
        marks = shard["mark"].to_numpy().view(np.uint32)
        ids = shard["doc_id"].to_numpy()
        order = np.lexsort((ids, marks, hashes))
        hashes, marks, ids = hashes[order], marks[order], ids[order]
        once = _new(hashes, marks, ids)
        hashes, marks, ids = hashes[once], marks[once], ids[once]
        starts = np.flatnonzero(_new(hashes, marks))
        ends = np.append(starts[1:], len(hashes))
        keys, names = hashes[starts], marks[starts]
        hashed = PerfectHash.over(keys, names)
        slots = hashed.slots(keys, names)
        fingerprints, counts, last = np.empty(len(keys), "<u4"), np.empty(len(keys), "<u4"), np.empty(len(keys), "<i8")
        fingerprints[slots] = names
        counts[slots] = np.minimum(ends - starts, min_docs)
        last[slots] = ids[ends - 1]
        row = (int(shard["shard"].iloc[0]), hashed.sizes, hashed.bits, fingerprints.tobytes(), counts.tobytes(), last.tobytes())
        return pd.DataFrame([row], columns=["shard", "sizes", "bits", "marks", "counts", "last"])

    return index


def _probe(min_docs: int):
    def probe(asked: pd.DataFrame, shards: pd.DataFrame) -> pd.DataFrame:
        names = ["block", "hash", "mark", "last"]
        if not len(asked) or not len(shards):
            return pd.DataFrame({c: [] for c in names}, dtype="int64")
        asked = asked[["block", "hash", "mark"]].drop_duplicates()
        hashes, marks = asked["hash"].to_numpy().view(np.uint64), asked["mark"].to_numpy().view(np.uint32)
        shard = shards.iloc[0]
        slots = PerfectHash(list(shard["sizes"]), shard["bits"]).slots(hashes, marks)
        fingerprints, counts = np.frombuffer(shard["marks"], "<u4"), np.frombuffer(shard["counts"], "<u4")
        known = (slots >= 0) & (fingerprints[slots] == marks) & (counts[slots] >= min_docs)
        out = asked[known]
        return out.assign(last=np.frombuffer(shard["last"], "<i8")[slots[known]])

    return probe


def _cut(least: int):
    def cut(texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        both = np.empty(len(answers), dtype=[("hash", "<u8"), ("mark", "<u4")])
        both["hash"], both["mark"] = answers["hash"].to_numpy().view(np.uint64), answers["mark"].to_numpy().view(np.uint32)
        raw = both.tobytes()
        gone = {raw[i : i + 12]: last for i, last in zip(range(0, len(raw), 12), answers["last"].tolist())}
        rows = []
        for doc_id, own, text in zip(texts["doc_id"], _ids(texts["doc_id"]).tolist(), texts["text"]):
            lines = encoded(text).split(b"\n")
            kept = lines
            if gone:
                keys = (key_of(line, least) for line in lines)
                lost = [key is not None and gone.get(_digest(key), own) != own for key in keys]
                if any(lost):
                    kept = [line for line, out in zip(lines, lost) if not out]
            rows.append((doc_id, len(lines), len(lines) - len(kept), b"\n".join(kept).decode("utf-8", "replace")))
        out = pd.DataFrame(rows, columns=["doc_id", "n_lines", "n_dropped", "kept_text"])
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    return cut


def asked_keys(docs: DataFrame, blocks: int, shards: int, min_docs: int = 3, least: int = 20) -> tuple[DataFrame, DataFrame]:
    """Documents dealt into blocks, and the distinct keys of every block on their way to their shards."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = own.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    return own, own.groupBy("block").applyInPandas(_ask(shards, min_docs, least), ASKED)


def line_index(asked: DataFrame, min_docs: int = 3) -> DataFrame:
    """One row a shard: the levels of its perfect hash and the arrays that its slots point into.

    ``counts`` are documents holding the key, up to ``min_docs``; ``last`` is the largest id among them.
    """
    return asked.groupBy("shard").applyInPandas(_index(min_docs), INDEX)


def without_shared_lines(
    docs: DataFrame,
    min_docs: int = 3,
    least: int = 20,
    block_bytes: int = BLOCK_BYTES,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_text`` of every row of ``docs``.

    A line's key has the blanks at both ends stripped and A-Z in lower case. Keys of
    at least ``least`` code points in at least ``min_docs`` documents lose their lines
    everywhere but in the largest id that holds one; there all of them stay. A null
    or empty text is one empty line. Rows of one id are one document; rows without an
    id are together one document before all others. An empty table gives no rows;
    other columns are ignored. A text is never cut: a very long one is a block's
    whole load.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, shards = pieces_for(size, block_bytes), pieces_for(size, shard_bytes)
    own, asked = asked_keys(docs, blocks, shards, min_docs, least)
    index = line_index(asked, min_docs)
    answers = asked.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(_probe(min_docs), ANSWER)
    return own.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_cut(least), RESULT)


def line_report(docs: DataFrame) -> DataFrame:
    found = without_shared_lines(docs)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
