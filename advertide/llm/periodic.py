"""Find every maximal periodic run of words, by longest common extensions in suffix trees.

A run is a stretch of words with a smallest period that it repeats a few times
and that no neighbouring word carries on. Each run has a Lyndon root: at some
place of it, the longest Lyndon word that begins there, under the order of the
words or under the opposite one, is as long as the period. So:

1. Ukkonen's algorithm builds the suffix tree of the words and that of their
   reversal. An Euler tour of either, with a sparse table of least depths, gives
   the lowest common ancestor of two leaves in constant time: how far two places
   agree to the right, and to the left.
2. The order of the leaves ranks the suffixes. The longest Lyndon word at a place
   ends where the next smaller suffix begins, so one stack a word order gives one
   candidate a place.
3. A candidate's two ends are extended both ways as far as words one period apart
   agree; what is long enough is a run, and its period the smallest.

Trees are built only over stretches that can hold a run: within a run of period
q, three words in a row stand again at most q words later, at three times q
places in a row or more but for the last two. Gaps between equal word triples,
by powers of two of q, find these stretches in numpy; whatever lies outside has
no run. Triples are compared by hashes there, which can only add a stretch; the
trees compare the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advertide.llm.words import encoded, mix, separators, sliced, windows, word_hashes

WORDS = r"[^\x20\x09-\x0D]+"
RESULT = "doc_id long, runs array<struct<start:long,length:long,period:long>>, kept_text string"


class SuffixTree:
    """Ukkonen's suffix tree of a list of numbers from 0, closed by an end mark of its own below them all."""

    def __init__(self, symbols: list[int]):
        text = [*symbols, -1]
        n = len(text)
        self.start, self.end, self.link = [0], [0], [0]
        self.children: list[dict[int, int] | None] = [{}]
        self.suffix, self.size = [-1], n
        start, end, link, children, suffix = self.start, self.end, self.link, self.children, self.suffix
        node = edge = length = waiting = 0
        for i, symbol in enumerate(text):
            waiting += 1
            linked = 0
            while waiting:
                if not length:
                    edge = i
                child = children[node].get(text[edge])
                if child is None:
                    children[node][text[edge]] = len(start)
                    start.append(i), end.append(n), link.append(0), children.append(None), suffix.append(i - waiting + 1)
                    if linked:
                        link[linked] = node
                        linked = 0
                else:
                    span = end[child] - start[child]
                    if length >= span:
                        edge, length, node = edge + span, length - span, child
                        continue
                    below = text[start[child] + length]
                    if below == symbol:
                        length += 1
                        if linked:
                            link[linked] = node
                        break
                    inner = len(start)
                    start.append(start[child]), end.append(start[child] + length), link.append(0), suffix.append(-1)
                    children.append({below: child, symbol: inner + 1})
                    children[node][text[edge]] = inner
                    start[child] += length
                    start.append(i), end.append(n), link.append(0), children.append(None), suffix.append(i - waiting + 1)
                    if linked:
                        link[linked] = inner
                    linked = inner
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1

    def leaves(self, falling: bool) -> np.ndarray:
        """Rank of every suffix; the end mark is least, words ascend or descend behind it."""
        children, suffix = self.children, self.suffix
        rank, at, todo = np.zeros(self.size, dtype=np.int64), 0, [0]
        order: list[int] = []
        while todo:
            node = todo.pop()
            below = children[node]
            if below is None:
                order.append(suffix[node])
                continue
            # The last pushed is read first: the end mark, then the rest.
            words = sorted(below, reverse=not falling)
            if falling and words[0] == -1:
                words = [*words[1:], -1]
            todo.extend(map(below.__getitem__, words))
        rank[order] = np.arange(self.size)
        return rank

    def extensions(self) -> Extensions:
        """The Euler tour: depth of every node as it is met and met again, and where each leaf stands in it."""
        start, end, children, suffix = self.start, self.end, self.children, self.suffix
        tour: list[int] = []
        first = [0] * self.size
        todo = [(0, 0)]
        while todo:
            node, depth = todo.pop()
            if node >= 0:
                below = children[node]
                if below is None:
                    first[suffix[node]] = len(tour)
                    depth += end[node] - start[node]
                else:
                    depth += end[node] - start[node]
                    for child in below.values():
                        todo.append((-1, depth))
                        todo.append((child, depth))
            tour.append(depth)
        return Extensions(np.array(tour, dtype=np.int32), np.array(first, dtype=np.int64))


class Extensions:
    """How many words agree from two places on: the least depth of the tour between two leaves, by a sparse table."""

    def __init__(self, tour: np.ndarray, first: np.ndarray):
        self.first = first
        self.table = np.empty((len(tour).bit_length(), len(tour)), dtype=np.int32)
        self.table[0] = tour
        for level in range(1, len(self.table)):
            half = 1 << (level - 1)
            self.table[level] = self.table[level - 1]
            np.minimum(self.table[level - 1][:-half], self.table[level - 1][half:], out=self.table[level][:-half])

    def agree(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For pairs of different places."""
        a, b = self.first[left], self.first[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        return np.minimum(self.table[level, low], self.table[level, high - (1 << level) + 1]).astype(np.int64)


def _next_smaller(rank: np.ndarray) -> np.ndarray:
    """For every place but the last the next place of a smaller rank; the last, the end mark, is the least of all."""
    ranks = rank.tolist()
    out, stack = [0] * (len(ranks) - 1), [len(ranks) - 1]
    for i in range(len(ranks) - 2, -1, -1):
        own = ranks[i]
        while ranks[stack[-1]] > own:
            stack.pop()
        out[i] = stack[-1]
        stack.append(i)
    return np.array(out, dtype=np.int64)


def runs_in(symbols: list[int], times: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """``start, length, period`` of every run of at least ``times`` periods and ``least`` symbols, by start, then period."""
    n = len(symbols)
    if n < max(times, least):
        return []
    tree = SuffixTree(symbols)
    right, left = tree.extensions(), SuffixTree(symbols[::-1]).extensions()
    place = np.arange(n)
    found = []
    for falling in (False, True):
        after = _next_smaller(tree.leaves(falling))
        period = after - place
        fits = times * period <= n
        begin, until, period = place[fits], after[fits], period[fits]
        before = left.agree(n - begin, n - until)
        length = until + right.agree(begin, until) - begin + before
        long = (length >= times * period) & (length >= least)
        found.append(np.stack([begin - before, length, period], axis=1)[long])
    distinct = {tuple(run) for part in found for run in part.tolist()}
    return sorted(distinct, key=lambda run: (run[0], run[2]))


def _stretches(hashes: np.ndarray, bounds: np.ndarray, times: int, least: int) -> dict[int, list[tuple[int, int]]]:
    """By text: spans of word numbers that hold every run with a word to spare, apart from one another."""
    if times < 4:  # a run may be too short for three words to stand again in it
        return {i: [(0, int(n))] for i, n in enumerate(np.diff(bounds)) if n}
    triples, owner, first = windows(hashes, bounds, 3)
    if not len(triples):
        return {}
    keys = mix(triples + mix(owner.astype(np.uint64)))
    order = np.argsort(keys, kind="stable")
    gap = np.full(len(keys), np.iinfo(np.int64).max)
    again = keys[order][1:] == keys[order][:-1]
    gap[order[:-1][again]] = (first[order[1:]] - first[order[:-1]])[again]
    apart = np.concatenate([[True], owner[1:] != owner[:-1], [True]])
    most = int(np.diff(bounds).max())
    spans: list[np.ndarray] = []
    period = 1
    while times * period <= most:
        # Periods from this power of two up to the next; the first of them asks for the fewest places.
        limit = 2 * period - 1
        need = max((times - 1) * period, least - limit) - 2
        near = np.concatenate([[False], gap <= limit, [False]])
        opens = np.flatnonzero(near[1:] & (~near[:-1] | apart))[: len(near)]
        closes = np.flatnonzero(near[:-1] & (~near[1:] | apart))
        wide = closes - opens >= max(need, 1)
        if wide.any():
            a, b = first[opens[wide]], first[closes[wide] - 1]
            text = owner[opens[wide]]
            low, high = bounds[text], bounds[text + 1]
            spans.append(np.stack([text, np.maximum(a - 1, low) - low, np.minimum(b + limit + 4, high) - low], axis=1))
        period *= 2
    out: dict[int, list[tuple[int, int]]] = {}
    if spans:
        for text, low, high in sorted(map(tuple, np.concatenate(spans).tolist())):
            held = out.setdefault(text, [])
            if held and low <= held[-1][1]:
                held[-1] = (held[-1][0], max(held[-1][1], high))
            else:
                held.append((low, high))
    return out


def text_runs(texts: list[bytes], times: int = 4, least: int = 6) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Words and runs of each text."""
    blank = separators()
    for part in sliced(texts):
        hashes, bounds = word_hashes(texts[part], blank)
        stretches = _stretches(hashes, bounds, times, least)
        for i in range(part.start, part.stop):
            words, runs = texts[i].split(), []
            for low, high in stretches.get(i - part.start, ()):
                numbers: dict[bytes, int] = {}
                symbols = [numbers.setdefault(w, len(numbers)) for w in words[low:high]]
                runs += [(low + start, length, period) for start, length, period in runs_in(symbols, times, least)]
            yield words, runs


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds behind its first period."""
    if not runs:
        return words
    turn = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        turn[start + period] += 1
        turn[start + length] -= 1
    gone = np.cumsum(turn[:-1]) > 0
    return [w for w, out in zip(words, gone) if not out]


def periodic_runs(docs: DataFrame, times: int = 4, least: int = 6) -> DataFrame:
    """``doc_id, runs, kept_text`` of every row of ``docs``.

    Words are maximal runs of characters that are no blanks. ``runs`` holds start
    (word number), length and smallest period of every maximal run of at least
    ``times`` periods and ``least`` words, by start, then period. ``kept_text``
    joins by one space the words that no run holds behind its first period. A null or
    empty text has no words. A row is judged by its own text alone, so repeated rows
    give equal rows and an empty table none; other columns are ignored. Memory follows
    the longest stretch of one text in which words keep repeating.
    """

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, (words, runs) in zip(batch["doc_id"], text_runs([encoded(t) for t in batch["text"]], times, least)):
                held = [{"start": s, "length": n, "period": p} for s, n, p in runs]
                rows.append((doc_id, held, b" ".join(collapsed(words, runs)).decode("utf-8", "replace")))
            out = pd.DataFrame(rows, columns=["doc_id", "runs", "kept_text"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInPandas(found, RESULT)


def planted(docs: DataFrame, one_in: int = 10) -> DataFrame:
    """``doc_id, text``: in one of so many documents, by a checksum of the id, the words from some place on repeat.

    A row without an id stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", h.alias("_h"), F.floor(h / one_in).alias("_g"))
    words = F.when(F.col("_h") % one_in == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORDS), F.lit(0)))
    own = own.withColumn("_words", words)
    n = F.size("_words")
    own = own.withColumn("_a", F.when(n > 0, F.col("_g") % n))
    own = own.withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8)))
    a, p, held = F.col("_a"), F.col("_p"), F.col("_words")
    every = F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)
    moved: Column = F.transform(every, lambda i: F.get(held, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
    return own.select("doc_id", F.when(n > 0, F.array_join(moved, " ")).otherwise(F.col("text")).alias("text"))


def run_report(docs: DataFrame) -> DataFrame:
    """Digests of every document's runs, and the greatest of them (ties: smallest start, then period).

    Runs come from :func:`periodic_runs` over :func:`planted` texts, with their
    handling of nulls, repeats and empty tables. Without a run the four figures are
    null and the digest is that of nothing.
    """
    rows = periodic_runs(planted(docs)).withColumn(
        "best",
        F.array_min(
            F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("s"), r["period"].alias("p")))
        ),
    )
    length = -F.col("best.n")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    said = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.s").alias("start"),
        length.alias("length"),
        F.col("best.p").alias("period"),
        F.floor(1000 * length / F.col("best.p")).cast("long").alias("exponent_milli"),
        F.sha2(said.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("kept_text").cast("binary"), 256).alias("collapsed_sha256"),
    )
