"""Token counts of documents in flat token files that have no index.

A file is a run of two-byte token ids in blocks; a document ends with a separator id, wherever a block ends.
Each block is searched by itself; running sums and maxima over the block summaries of a file then give the
number and place of the separators before every block, which stitches documents that cross blocks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.arrays import as_bytes

SEPARATOR = 50_256
BLOCK_TOKENS = 65_536
# Fixed value: the pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file)}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def flat_token_blocks(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, tokens, ids): one flat token file per task, cut into blocks of ``block_tokens`` ids.

    Rows with ``tokens`` are the file. Rows with ``ids`` and block -1, -2, ... list the document ids in writing order,
    ``block_tokens`` a row; the count does not read them. Null and empty texts are a separator alone. A task holds one
    unfinished block and one list. Write the result before it is read twice: file numbers are those of the tasks.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, file = _encoding(vocabulary), TaskContext.get().partitionId()
        wait, held, block, names, listed = [], 0, 0, [], 0

        def row(number, tokens, ids):
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([number], pa.int64()), pa.array([tokens], pa.binary()), pa.array([ids], pa.list_(pa.int64()))], names=["file", "block", "tokens", "ids"])

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                ids = encoding.encode_ordinary(text.decode("utf-8", "replace"))
                ids.append(SEPARATOR)
                wait.append(np.array(ids, dtype="<u2"))
                held += len(ids)
                names.append(name)
                if held >= block_tokens:
                    run = np.concatenate(wait)
                    for lo in range(0, held - block_tokens + 1, block_tokens):
                        yield row(block, run[lo : lo + block_tokens].tobytes(), None)
                        block += 1
                    wait, held = [run[held - held % block_tokens :]], held % block_tokens
                if len(names) == block_tokens:
                    listed += 1
                    yield row(-listed, None, names)
                    names = []
        if held:
            yield row(block, np.concatenate(wait).tobytes(), None)
        if names:
            yield row(-listed - 1, None, names)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(write, "file long, block long, tokens binary, ids array<long>")


def read_token_files(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, tokens) of flat binary files; ``file`` is the path."""
    whole = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    last = F.greatest(F.ceil(F.octet_length("content") / (2 * block_tokens)) - 1, F.lit(0))
    cut = whole.select("file", "content", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    return cut.select("file", "block", F.substring("content", (F.col("block") * 2 * block_tokens + 1).cast("int"), F.lit(2 * block_tokens)).alias("tokens"))


def _search(separator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ends = [], []
            for tokens in as_bytes(batch.column(2)):
                ids = np.frombuffer(tokens, dtype="<u2")
                sizes.append(len(ids))
                ends.append(np.flatnonzero(ids == separator).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], names=["file", "block", "size", "ends"])

    return run


def document_token_counts(blocks: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """(file, ordinal, start, n_tokens, closed) of every document, ordinals from 0 in file order.

    ``n_tokens`` leaves the separator out. Tokens after a file's last separator are a document that is not ``closed``.
    Null and empty blocks hold nothing; an empty table gives no rows.
    """
    kind = blocks.schema["file"].dataType.simpleString()
    found = blocks.where("block >= 0").select("file", "block", "tokens").mapInArrow(_search(separator), f"file {kind}, block long, size long, ends array<long>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    placed = found.withColumn("offset", F.sum("size").over(upto) - F.col("size"))
    placed = placed.withColumn("last", F.when(F.size("ends") > 0, F.col("offset") + F.array_max("ends")))
    placed = placed.select(
        "file", "block", "size", "offset", "ends",
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("seen"),
        F.coalesce(F.max("last").over(before), F.lit(-1).cast("long")).alias("carry"),
        F.lead("block").over(Window.partitionBy("file").orderBy("block")).alias("next"), "last",
    )
    start = F.expr("if(k = 0, carry, offset + ends[k - 1]) + 1")
    closed = placed.select("*", F.posexplode("ends").alias("k", "end")).select("file", (F.col("seen") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("offset") + F.col("end") - start).alias("n_tokens"), F.lit(True).alias("closed"))
    open_from = F.greatest(F.coalesce("last", F.lit(-1)), "carry") + 1
    tail = placed.where(F.col("next").isNull()).select("file", (F.col("seen") + F.size("ends")).alias("ordinal"), open_from.alias("start"), (F.col("offset") + F.col("size") - open_from).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.union(tail.where("n_tokens > 0"))


def named_counts(blocks: DataFrame, block_tokens: int = BLOCK_TOKENS, separator: int = SEPARATOR) -> DataFrame:
    """(id, file, ordinal, n_tokens) for blocks from ``flat_token_blocks``: counts next to the listed ids."""
    listed = blocks.where("block < 0").select("file", "block", F.posexplode("ids").alias("k", "id"))
    listed = listed.select("id", "file", (-(F.col("block") + 1) * F.lit(block_tokens) + F.col("k")).alias("ordinal"))
    return listed.join(document_token_counts(blocks, separator), ["file", "ordinal"]).select("id", "file", "ordinal", "n_tokens")
