"""Pack documents into token sequences by best-fit decreasing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from advertide.llm.exchange import pieces_for
from advertide.llm.tokens import default_tokenizer, encoder

# Pieces packed together. A shard ends with a few bins of its own that are not full.
SHARD_DOCS = 1 << 15
PIECE = "doc_id long, piece int, start long, length long, ids binary"


def token_pieces(
    docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer: str | None = None
) -> DataFrame:
    """Every document's ids and ``end_id``, cut where longer than ``capacity``: ``doc_id, piece, start, length, ids``.

    Full pieces stand at the end of a document, so only its first piece may be
    shorter. ``ids`` are little-endian unsigned 32-bit. A null text is the empty
    one: its only id is the end. Repeated rows are pieces of their own.
    """
    path = tokenizer or default_tokenizer()
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.iloc[at : at + 256]
                rows = []
                for doc_id, found in zip(some["doc_id"], encoder(path).encode(list(some["text"]))):
                    ids = found + end
                    n = len(ids) // 4
                    start, length = 0, n % capacity or capacity
                    for piece in range(-(-n // capacity)):
                        rows.append((doc_id, piece, start, length, ids[4 * start : 4 * (start + length)]))
                        start, length = start + length, capacity
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInPandas(cut, PIECE)


class OpenBins:
    """Remaining capacities of open bins under a segment tree: the tightest bin that fits, in logarithmic time.

    A leaf is a remaining capacity, its value the number of open bins with it. An
    inner node holds the sum of its leaves, so the least capacity at or above a
    length is found by one walk up and one walk down.
    """

    def __init__(self, capacity: int):
        self.leaves = 1 << (capacity + 1).bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, bin_id: int) -> None:
        self.bins[room].append(bin_id)
        node = room + self.leaves
        while node:
            self.counts[node] += 1
            node >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """Remove and return (room, bin) of the tightest bin with room for ``length``; None without one."""
        counts, node = self.counts, length + self.leaves
        if not counts[node]:
            while node > 1 and not (node % 2 == 0 and counts[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if counts[2 * node] else 2 * node + 1
        room = node - self.leaves
        while node:
            counts[node] -= 1
            node >>= 1
        return room, self.bins[room].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every length, longest first, each into the tightest bin that still takes it."""
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    tree, used = OpenBins(capacity), 0
    for i in np.argsort(-lengths, kind="stable"):
        length = int(lengths[i])
        found = tree.take(length) if length < capacity else None
        if found is None:
            room, bin_id, used = capacity, used, used + 1
        else:
            room, bin_id = found
        bins[i], offsets[i] = bin_id, capacity - room
        if room > length:
            tree.put(room - length, bin_id)
    return bins, offsets


def pack(pieces: DataFrame, shards: int, capacity: int = 1024) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of at most ``capacity`` tokens.

    Shards are dealt by a hash of id and place and packed on their own: each is a
    bounded group whatever the corpus, and wastes at most the last open bins of one
    best-fit run. Sequence ids count up in steps of ``shards``, so no two shards share one.
    """
    names = [f for f in pieces.columns if f != "shard"]
    schema = ", ".join(f"{n} {t}" for n, t in pieces.select(*names).dtypes)

    def fill(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["doc_id", "piece", "start"], kind="stable").reset_index(drop=True)
        bins, offsets = best_fit_decreasing(shard["length"].to_numpy(), capacity)
        shard["sequence_id"] = bins * shards + shard["shard"].to_numpy()
        shard["offset"] = offsets
        return shard.drop(columns="shard")

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.lit("shard")), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(fill, f"{schema}, sequence_id long, offset long")


def packed_report(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer: str | None = None) -> DataFrame:
    """Where each piece of each document lies, with a checksum of its ids in place of the ids."""
    pieces = token_pieces(docs, capacity, end_id, tokenizer).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(pieces, pieces_for(docs.count(), SHARD_DOCS), capacity)
