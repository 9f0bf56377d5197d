"""Conversations as training text with an offset-aligned loss mask.

A conversation is rendered whole, encoded once with offsets, and the spans of its
assistant turns are intersected with the token spans by binary search. Turns are
marked by control strings that are single tokens, so no token reaches over the
edge of a turn. Control strings inside texts are escaped: every ``<``, run of
backslashes, ``|`` gets one more backslash, which reading takes off again.

    <|im_start|>role<|im_sep|>text<|im_end|>
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from advertide.llm.tokens import default_tokenizer

START, BETWEEN, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
RENDERED = "conv_id long, formatted string, ids array<int>, offsets array<int>, loss_mask array<boolean>, loss_spans array<struct<start:int,end:int>>"
READ = "conv_id long, n_turns long, turns string, loss_text string, formatted_chars long"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(turns: list[tuple[str, str]], loss_role: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The text of a conversation and the spans of the texts of ``loss_role`` in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{BETWEEN}", escape(text)
        if role == loss_role and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def mask_of(offsets: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which tokens lie in a span, and what of the spans those tokens cover.

    Token spans ascend, as do turn spans: each turn's tokens are one run, found by two
    binary searches. Tokens of one character's bytes share its offsets.
    """
    mask, covered = np.zeros(len(offsets), dtype=bool), []
    for start, end in spans:
        first = int(np.searchsorted(offsets[:, 1], start, side="right"))
        last = int(np.searchsorted(offsets[:, 0], end, side="left"))
        mask[first:last] = True
        if first < last:
            covered.append((max(start, int(offsets[first, 0])), min(end, int(offsets[last - 1, 1]))))
    return mask, covered


def formatted(conversations: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row a conversation: its text, ids, token offsets (flat pairs, in code points), loss mask and loss spans.

    Turns stand by ``turn`` (null first), then role and text. Null roles and texts are
    empty; rows without ``conv_id`` are one conversation. A conversation is rendered
    whole, so its own rows meet in one task; different conversations never do.
    """
    path = tokenizer or default_tokenizer()
    said = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(said)).alias("turns"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.add_special_tokens([START, BETWEEN, END])
        for batch in batches:
            for at in range(0, len(batch), 64):
                some = batch.iloc[at : at + 64]
                made = [render([(t["role"], t["text"]) for t in turns]) for turns in some["turns"]]
                rows = []
                for conv_id, (text, spans), found in zip(some["conv_id"], made, tok.encode_batch([m[0] for m in made], add_special_tokens=False)):
                    offsets = np.array(found.offsets, dtype=np.int32).reshape(-1, 2)
                    mask, covered = mask_of(offsets, spans)
                    rows.append((conv_id, text, found.ids, offsets.ravel(), mask, [{"start": s, "end": e} for s, e in covered]))
                out = pd.DataFrame(rows, columns=["conv_id", "formatted", "ids", "offsets", "loss_mask", "loss_spans"])
                out["conv_id"] = out["conv_id"].astype("Int64")
                yield out

    return whole.mapInPandas(encode, RENDERED)


def read_back(made: DataFrame) -> DataFrame:
    """What rendered rows say: turns as ``role, newline, text, newline``, and the text under the loss mask."""
    turn = re.compile(f"{re.escape(START)}(.*?){re.escape(BETWEEN)}(.*?){re.escape(END)}", re.S)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for conv_id, text, offsets, mask, spans in zip(*(batch[c] for c in ("conv_id", "formatted", "offsets", "loss_mask", "loss_spans"))):
                turns = [(unescape(r), unescape(t)) for r, t in turn.findall(text)]
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                rows.append((conv_id, len(turns), "".join(f"{r}\n{t}\n" for r, t in turns), loss, len(text)))
            out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns", "loss_text", "formatted_chars"])
            out["conv_id"] = out["conv_id"].astype("Int64")
            yield out

    return made.mapInPandas(parse, READ)


def chat_report(conversations: DataFrame, tokenizer: str | None = None) -> DataFrame:
    read = read_back(formatted(conversations, tokenizer))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return read.select(
        "conv_id", "n_turns", digest("turns").alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        digest("loss_text").alias("loss_sha256"), "formatted_chars",
    )
