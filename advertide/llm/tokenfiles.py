"""Flat token files without an index, and the documents that a scan for separators finds in them.

A file is a run of unsigned 16-bit ids; a document ends at the end-of-document id.
The writer is Spark's own text writer with that id's bytes as line end. The scan
cuts files into blocks, finds the separators of a block with one vectorised
comparison, and stitches documents that reach over block edges by a prefix scan:
a block's first separator closes what the blocks since the last separator held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from advertide.llm.tokens import default_tokenizer, encoder
from advertide.session import work_folder

END_OF_DOCUMENT = 50256
BLOCK_BYTES = 1 << 20
BLOCK = "file string, block long, tokens long, tail long, first long, lengths array<long>"


def write_token_file(docs: DataFrame, path: str, end_id: int = END_OF_DOCUMENT, tokenizer: str | None = None) -> None:
    """Write the ids of every text, each document closed by ``end_id``; a null text is an empty document.

    The end id's own string inside a text is ordinary text, so the id means an end wherever it stands.
    """
    source = tokenizer or default_tokenizer()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                yield pd.DataFrame({"ids": encoder(source, "<u2", True).encode(list(batch["text"].iloc[at : at + 256]))})

    ids = docs.select("text").mapInPandas(encode, "ids binary")
    end = np.array([end_id], dtype="<u2").tobytes().decode("latin-1")
    ids.select(F.col("ids").cast("string").alias("value")).write.option("lineSep", end).option("encoding", "ISO-8859-1").text(path)


def _scan(end_id: int):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, block, content in zip(batch["file"], batch["block"], batch["content"]):
                ids = np.frombuffer(content, dtype="<u2")
                ends = np.flatnonzero(ids == end_id)
                lengths = np.diff(ends) - 1
                tail = len(ids) - int(ends[-1]) - 1 if len(ends) else len(ids)
                rows.append((file, block, len(ids), tail, int(ends[0]) if len(ends) else None, lengths))
            out = pd.DataFrame(rows, columns=["file", "block", "tokens", "tail", "first", "lengths"])
            out["first"] = out["first"].astype("Int64")
            yield out

    return scan


def token_counts(spark: SparkSession, path: str, end_id: int = END_OF_DOCUMENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``file, document, start, n_tokens, closed`` of every document of the token files under ``path``.

    ``document`` counts from 0 in its file, ``start`` is its first token's place there;
    an empty document has no tokens. Tokens behind a file's last end are an open
    document. A file is a stream of its own and at most 2 GB, Spark's bound for a
    binary value; blocks of one file are ordered in a window of one small row each.
    """
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "length", "content")
    starts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / block_bytes))
    blocks = files.select(F.regexp_extract("path", "[^/]*$", 0).alias("file"), F.explode(starts).alias("block"), "content")
    content = F.substring("content", (F.col("block") * block_bytes + 1).cast("int"), F.lit(block_bytes))
    scanned = blocks.select("file", "block", content.alias("content")).mapInPandas(_scan(end_id), BLOCK)

    along = Window.partitionBy("file").orderBy("block")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    # Open tokens before a block: the tail of the last block with an end, and all blocks since.
    summed = scanned.withColumn("begin", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    last_end = F.last(F.when(F.col("first").isNotNull(), F.col("begin") + F.col("tokens") - F.col("tail")), ignorenulls=True)
    summed = summed.withColumn("opened", F.coalesce(last_end.over(before), F.lit(0)))
    ends = F.when(F.col("first").isNull(), 0).otherwise(F.size("lengths") + 1)
    summed = summed.withColumn("documents", F.coalesce(F.sum(ends).over(before), F.lit(0)))
    summed = summed.withColumn("last", F.lead("block").over(along).isNull())
    own = F.concat(
        F.when(F.col("first").isNotNull(), F.array(F.col("begin") + F.col("first") - F.col("opened"))).otherwise(F.array().cast("array<long>")),
        "lengths",
    )
    closed = summed.select("file", "documents", "opened", F.posexplode(own).alias("number", "n_tokens"), "begin", "first", "lengths")
    # A later document of a block starts behind its predecessors: their tokens and ends.
    passed = F.aggregate(F.slice(F.col("lengths"), F.lit(1), F.greatest(F.col("number") - 1, F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x + 1)
    start = F.when(F.col("number") == 0, F.col("opened")).otherwise(F.col("begin") + F.col("first") + 1 + passed)
    done = closed.select("file", (F.col("documents") + F.col("number")).alias("document"), start.alias("start"), "n_tokens", F.lit(True).alias("closed"))
    left = F.when(F.col("first").isNull(), F.col("begin") + F.col("tokens") - F.col("opened")).otherwise(F.col("tail"))
    rest = summed.where("last").select(
        "file", (F.col("documents") + ends).cast("long").alias("document"), (F.col("begin") + F.col("tokens") - left).alias("start"), left.alias("n_tokens"), F.lit(False).alias("closed")
    )
    return done.unionByName(rest.where("n_tokens > 0"))


def documents_through_files(docs: DataFrame, **places) -> DataFrame:
    """Write the documents as token files in the shared folder and count them from there."""
    path = work_folder(docs.sparkSession, "token-files")
    write_token_file(docs, path, **places)
    return token_counts(docs.sparkSession, path)
