"""Jaccard join of documents on word n-grams, exact, by size-banded tiles.

1. *Counts.* Blocks of documents send their distinct shingle hashes, in hash
   order, to buckets; a bucket answers with the document frequency of every
   shingle that at least two documents hold. A document of which fewer than the
   threshold's share of shingles is shared can have no partner and is settled.
2. *Candidates.* Two sets at or above the threshold share one of each one's
   rarest shingles (a prefix as long as the threshold allows to miss, plus one;
   rarest first, by hash among equals, the same order everywhere). Sets are
   grouped by such a shingle and a band of sizes no wider than the threshold's
   ratio; every member is tied to the group's least member, and a band to the
   next. Components of these ties hold all partners together.
3. *Tiles.* A component is cut into tiles of a size band (or two adjacent ones)
   and slices of it, so a large group is many bounded tiles. In a tile, sets in
   size order meet those of fitting size: parity bitmaps bound the overlap from
   above by their differing bits, the survivors are intersected exactly as
   sorted arrays. Members already joined are not compared again, and a tile
   emits a spanning forest of its links, never all pairs.
4. *Components* of the links are the result.

Equal sets meet as one, by a digest of the set. Nothing is capped or sampled.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from advertide.llm.components import connected
from advertide.llm.exchange import bucket_edges, pack, pack_counts, pieces_for, unpack, unpack_counts
from advertide.llm.words import encoded, mix, separators, sliced, windows, word_hashes
from advertide.session import stage

BLOCK_DOCS = 2048
# Shingles are counted by their first 40 bits: a chance agreement only makes a shingle look shared.
COUNT_BITS = 40
# Members of one class or band that meet in one task when they learn its name or cut.
SLOT_DOCS = 128
# A tile holds about twice as many sets, or as many set members in all.
TILE_SETS, TILE_MEMBERS = 256, 1 << 20
SETS = "doc_id long, n long, digest binary, keys array<long>, members binary"


def _sets(texts: list[bytes], k: int):
    """The distinct shingle hashes of each text, ascending."""
    blank = separators()
    for part in sliced(texts):
        hashes, bounds = word_hashes(texts[part], blank, lower=True)
        shingles, owner, _ = windows(hashes, bounds, k)
        edges = np.searchsorted(owner, np.arange(part.stop - part.start + 1))
        for i in range(part.stop - part.start):
            if edges[i] < edges[i + 1]:
                yield np.unique(shingles[edges[i] : edges[i + 1]])
            elif bounds[i] < bounds[i + 1]:
                few = hashes[bounds[i] : bounds[i + 1]]
                yield mix(np.array([int.from_bytes(hashlib.blake2b(few.tobytes(), digest_size=8).digest(), "little")], np.uint64))
            else:
                yield np.empty(0, np.uint64)


def _ask(k: int, bits: int):
    def ask(block: pd.DataFrame) -> pd.DataFrame:
        held = [s >> np.uint64(64 - COUNT_BITS) for s in _sets([encoded(t) for t in block["text"]], k)]
        every, counts = np.unique(np.concatenate(held), return_counts=True)
        edges = bucket_edges(every, bits, COUNT_BITS)
        full = np.flatnonzero(np.diff(edges))
        return pd.DataFrame(
            {
                "bucket": full.astype(np.int32),
                "block": np.full(len(full), block["block"].iloc[0], dtype=np.int32),
                "hashes": [pack(every[edges[b] : edges[b + 1]]) for b in full],
                "counts": [pack_counts(counts[edges[b] : edges[b + 1]]) for b in full],
            }
        )

    return ask


def _answer(bucket: pd.DataFrame) -> pd.DataFrame:
    """To each block the document frequency of those of its shingles that are shared."""
    bucket = bucket.sort_values("block")
    parts = [unpack(b) for b in bucket["hashes"]]
    every = np.concatenate(parts)
    counts = np.concatenate([unpack_counts(c) for c in bucket["counts"]]).astype(np.int64)
    distinct, where = np.unique(every, return_inverse=True)
    total = np.bincount(where, weights=counts, minlength=len(distinct)).astype(np.int64)[where]
    out, at = [], 0
    for block, part in zip(bucket["block"], parts):
        own = total[at : at + len(part)]
        at += len(part)
        shared = own > 1
        if shared.any():
            out.append((block, pack(part[shared]), pack_counts(np.minimum(own[shared], 2**32 - 1))))
    return pd.DataFrame(out, columns=["block", "hashes", "counts"])


def _settle(k: int, percent: int):
    def settle(texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        names = ["doc_id", "n", "digest", "keys", "members"]
        if not len(texts):
            return pd.DataFrame({c: [] for c in names})
        known, often = np.zeros(1, np.uint64), np.zeros(1, np.int64)
        if len(answers):
            known = np.concatenate([unpack(b) for b in answers["hashes"]])
            often = np.concatenate([unpack_counts(c) for c in answers["counts"]]).astype(np.int64)
            order = np.argsort(known)
            known, often = known[order], often[order]
        rows = []
        for doc_id, members in zip(texts["doc_id"], _sets([encoded(t) for t in texts["text"]], k)):
            n = len(members)
            short = members >> np.uint64(64 - COUNT_BITS)
            at = np.minimum(np.searchsorted(known, short), len(known) - 1)
            frequency = np.where(known[at] == short, often[at], 1) if len(answers) else np.ones(n, np.int64)
            shared = int((frequency > 1).sum())
            if pd.isna(doc_id) or not n or 100 * shared < percent * n:
                rows.append((doc_id, n, None, None, None))
                continue
            prefix = n - -(-percent * n // 100) + 1
            rarest = np.lexsort((members, frequency))[:prefix]
            keys = members[rarest[frequency[rarest] > 1]].view(np.int64)
            rows.append((doc_id, n, hashlib.blake2b(members.tobytes(), digest_size=16).digest(), keys, pack(members)))
        out = pd.DataFrame(rows, columns=names)
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    return settle


def _bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """Each set's members hashed to ``bits`` places, every place the parity of what fell there, as 64-bit words."""
    rows = np.zeros((len(sets), bits // 64), dtype=np.uint64)
    for row, members in zip(rows, sets):
        odd = np.bincount((members & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        row[:] = np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")
    return rows


def tile_links(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among these sets (in ascending size), as pairs of ids."""
    sizes = np.array([len(s) for s in sets])
    bits = 1 << max(6, int(sizes.max() // 2).bit_length())
    bitmaps, label, links = _bitmaps(sets, bits), np.arange(len(sets)), []
    for j in range(1, len(sets)):
        low = int(np.searchsorted(sizes, -(-percent * sizes[j] // 100)))
        near = low + np.flatnonzero(label[low:j] != label[j])
        if not len(near):
            continue
        # Differing bits are at most the members that one set has and the other has not.
        differing = np.bitwise_count(bitmaps[near] ^ bitmaps[j]).sum(axis=1)
        most = (sizes[near] + sizes[j] - differing) // 2
        near = near[100 * most >= percent * (sizes[near] + sizes[j] - most)]
        for i in near[::-1]:
            if label[i] == label[j]:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                links.append((int(ids[i]), int(ids[j])))
                label[label == label[i]] = label[j]
    return links


def _verify(percent: int):
    def verify(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values(["n", "node"]).reset_index(drop=True)
        links = tile_links(tile["node"].to_numpy(), [unpack(m) for m in tile["members"]], percent)
        return pd.DataFrame(links, columns=["low", "high"], dtype="int64")

    return verify


def _tiles(nodes: DataFrame, slots: int) -> DataFrame:
    """``node, tile`` rows: a small component is one tile; a large one is cut by size band and slice.

    What a band is cut into goes once to each of the ``slots`` that its nodes are spread over.
    """
    member = F.sum("n").alias("members")
    whole = nodes.groupBy("cluster").agg(F.count("*").alias("sets"), member)
    bands = nodes.groupBy("cluster", "band").agg(F.count("*").alias("sets"), member)
    slices = F.greatest(F.ceil(F.col("sets") / TILE_SETS), F.ceil(F.col("members") / TILE_MEMBERS)).cast("int")
    bands = bands.select("cluster", "band", slices.alias("slices")).join(
        whole.where((F.col("sets") > 2 * TILE_SETS) | (F.col("members") > 2 * TILE_MEMBERS)).select("cluster"), "cluster"
    )
    beside = bands.withColumn("own", F.col("slices"))
    for name, step in (("below", 1), ("above", -1)):
        other = bands.select("cluster", (F.col("band") + step).alias("band"), F.col("slices").alias(name))
        beside = beside.join(other, ["cluster", "band"], "left")
    beside = beside.drop("slices")
    nodes = nodes.withColumn("slot", F.pmod(F.xxhash64("node"), F.lit(slots)))
    beside = nodes.select("cluster", "band", "slot").distinct().join(beside, ["cluster", "band"])
    placed = nodes.join(beside, ["cluster", "band", "slot"], "left")
    mine = F.pmod(F.xxhash64("node"), F.col("own")).cast("int")
    placed = placed.withColumn("mine", mine)
    upto = lambda c: F.when(c > 0, F.sequence(F.lit(0), c - 1)).otherwise(F.array().cast("array<int>"))
    tile = lambda kind, band, a, b: F.concat_ws(":", F.lit(kind), band, a, b)
    m, band = F.col("mine"), F.col("band")
    tiles = F.when(F.col("own").isNull(), F.array(F.lit("all"))).otherwise(
        F.concat(
            F.transform(upto(F.col("own")), lambda b: tile("in", band, F.least(m, b), F.greatest(m, b))),
            F.transform(upto(F.coalesce("above", F.lit(0))), lambda b: tile("up", band, m, b)),
            F.transform(upto(F.coalesce("below", F.lit(0))), lambda b: tile("up", band - 1, b, m)),
        )
    )
    return placed.select("node", F.explode(F.transform(tiles, lambda t: F.xxhash64("cluster", t))).alias("tile"))


def joined(docs: DataFrame, k: int = 4, percent: int = 85, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``.

    A set is the distinct ``k``-word shingles (A-Z lower-cased), or the whole sequence
    where there are fewer words. Sets link at ``percent`` of Jaccard similarity or
    more; ``component_id`` is the least id reachable. A row without words links with
    nothing, a row without an id neither, and its component is its own id. Rows of
    one id are one document of all their links.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = pieces_for(own.count(), block_docs)
    bits = max(4, (blocks - 1).bit_length())
    own = own.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    asked = own.groupBy("block").applyInPandas(_ask(k, bits), "bucket int, block int, hashes binary, counts binary")
    answers = asked.groupBy("bucket").applyInPandas(_answer, "block int, hashes binary, counts binary")
    sets = own.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_settle(k, percent), SETS)
    sets = stage(sets, "jaccard-sets")

    slots = blocks * max(1, block_docs // SLOT_DOCS)
    classes = sets.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("node"))
    band = F.floor(F.log("n") / -math.log(percent / 100 - 0.01)).cast("int")
    keyed = sets.where("digest is not null").select("doc_id", "digest", "n", band.alias("band"), "keys")
    # A class meets its first member alone, not all its copies.
    firsts = classes.select(F.col("node").alias("doc_id"), "digest")
    keyed = keyed.join(firsts, ["doc_id", "digest"]).select(F.col("doc_id").alias("node"), "n", "band", F.explode("keys").alias("key"))
    least = keyed.groupBy("key", "band").agg(F.min("node").alias("least"), F.count("*").alias("sets"))
    least = stage(least.where("sets > 0"), "jaccard-groups").drop("sets")
    ties = keyed.join(least, ["key", "band"]).select("node", "least")
    upper = least.select("key", (F.col("band") - 1).alias("band"), F.col("least").alias("above"))
    ties = ties.union(least.join(upper, ["key", "band"]).select("least", "above"))
    clusters = connected(ties.where("node != least").distinct(), "jaccard-ties")

    sized = sets.where("digest is not null").select(F.col("doc_id").alias("node"), "n", band.alias("band")).distinct()
    nodes = stage(clusters.join(sized, "node").select("node", F.col("component").alias("cluster"), "n", "band"), "jaccard-nodes")
    members = sets.where("members is not null").select(F.col("doc_id").alias("node"), "n", "members")
    links = _tiles(nodes, slots).join(members, "node").groupBy("tile").applyInPandas(_verify(percent), "low long, high long")
    components = connected(links, "jaccard-links")

    # A class of many copies is spread over the slots; its name goes once to each.
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(slots)).alias("slot")
    named = classes.join(components, ["node"], "left").select("digest", F.coalesce("component", "node").alias("component"))
    named = sets.where("digest is not null").select("digest", slot).distinct().join(named, ["digest"])
    # A settled document matches no class: its own id keeps it from meeting the others on null.
    own_key = F.coalesce("digest", F.col("doc_id").cast("string").cast("binary"))
    rows = sets.select("doc_id", "n", own_key.alias("digest"), slot).join(named, ["digest", "slot"], "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
