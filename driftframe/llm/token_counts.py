"""Token counts of flat token files by a separator scan.

A flat file is token ids of two or four bytes without an index, an end-of-document id after each document. Its blocks are
searched for that id at once, each by itself; the counts and open ends of the blocks are stitched with a two-level
prefix scan, so that a document may lie in any number of blocks and no task walks a whole file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import materialize, texts

BLOCK_TOKENS = 1 << 17
#: Blocks in one part of the prefix scan.
SCAN_BLOCKS = 512
TOKENIZER, END_ID = "byte_bpe_50k.tiktoken", 50256


def separators(blocks: DataFrame, end_id: int, width: int = 2) -> DataFrame:
    """(file, block, n_tokens, ends) of each block of ``blocks`` (file, block, data binary): places of the end-of-document id."""
    kind = {2: "<u2", 4: "<u4"}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                tokens = np.frombuffer(batch.column("data")[k].as_py() or b"", dtype=kind)
                yield pa.RecordBatch.from_arrays([batch.column("file").slice(k, 1), batch.column("block").slice(k, 1), pa.array([len(tokens)], pa.int64()), pa.array([np.flatnonzero(tokens == end_id)], pa.list_(pa.int64()))], names=["file", "block", "n_tokens", "ends"])

    return blocks.select("file", "block", "data").mapInArrow(run, "file long, block long, n_tokens long, ends array<long>")


def _placed(blocks: DataFrame, end_id: int, width: int) -> DataFrame:
    """(file, block, n_tokens, ends, base, ordinal, open, final): tokens and documents before each block, where its first document begins, the file's last block."""
    found = materialize(separators(blocks, end_id, width), "separators")
    own = found.select("file", "block", "n_tokens", F.size("ends").alias("docs"), F.when(F.size("ends") > 0, F.element_at("ends", -1)).alias("last")).withColumn("part", F.floor(F.col("block") / SCAN_BLOCKS))
    sums = lambda w, c: F.coalesce(F.sum(c).over(w), F.lit(0))
    # first level: within each part; second level: over the parts
    inner = Window.partitionBy("file", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    near = own.withColumn("tokens_in", sums(inner, "n_tokens")).withColumn("docs_in", sums(inner, "docs"))
    near = near.withColumn("open_in", F.max(F.col("tokens_in") + F.col("last") + 1).over(inner))
    parts = near.groupBy("file", "part").agg(F.sum("n_tokens").alias("tokens"), F.sum("docs").alias("part_docs"), F.max(F.col("tokens_in") + F.col("last") + 1).alias("open"), F.max("block").alias("top"))
    outer = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("tokens_before", sums(outer, "tokens")).withColumn("docs_before", sums(outer, "part_docs"))
    parts = parts.withColumn("open_before", F.coalesce(F.max(F.col("tokens_before") + F.col("open")).over(outer), F.lit(0)))
    parts = parts.withColumn("final", F.max("top").over(Window.partitionBy("file")))
    placed = near.join(parts.select("file", "part", "tokens_before", "docs_before", "open_before", "final"), ["file", "part"])
    placed = placed.select("file", "block", (F.col("tokens_in") + F.col("tokens_before")).alias("base"), (F.col("docs_in") + F.col("docs_before")).alias("ordinal"), F.coalesce(F.col("open_in") + F.col("tokens_before"), "open_before").alias("open"), "final")
    return found.join(placed, ["file", "block"])


def _documents(placed: DataFrame) -> DataFrame:
    """(file, ordinal, start, n_tokens) of each document that ends in one of the ``placed`` blocks, or with the file."""
    joined = placed.withColumn("stops", F.transform("ends", lambda e: e + F.col("base")))
    document = "array<struct<ordinal:bigint,start:bigint,stop:bigint>>"
    start = lambda i: F.when(i == 0, F.col("open")).otherwise(F.get("stops", i - 1) + 1)
    whole = F.transform("stops", lambda e, i: F.struct((F.col("ordinal") + i).alias("ordinal"), start(i).alias("start"), e.alias("stop")))
    tail, total = F.coalesce(F.try_element_at("stops", F.lit(-1)) + 1, "open"), F.col("base") + F.col("n_tokens")
    rest = F.array(F.struct((F.col("ordinal") + F.size("ends")).alias("ordinal"), tail.alias("start"), total.alias("stop")))
    rest = F.when((F.col("block") == F.col("final")) & (total > tail), rest.cast(document)).otherwise(F.array().cast(document))
    return joined.select("file", F.explode(F.concat(whole.cast(document), rest)).alias("d")).select("file", "d.ordinal", "d.start", (F.col("d.stop") - F.col("d.start")).alias("n_tokens"))


def separator_scan(blocks: DataFrame, end_id: int = END_ID, width: int = 2) -> DataFrame:
    """(file, ordinal, start, n_tokens) of each document in the flat files of ``blocks`` (file, block, data binary).

    Blocks of a file are numbered from 0 without gaps or repeats, tokens not split between them. n_tokens leaves the end-of-document id out;
    two such ids side by side have an empty document between them; tokens after the last one are a document without an end; a document may
    be longer than any number of blocks. Null or empty blocks have no tokens; an empty table gives no rows.
    """
    return _documents(_placed(blocks, end_id, width))


def flat_files(documents: DataFrame) -> DataFrame:
    """(file, block, data, doc_ids): all documents as flat files of two-byte ids, one for each task, in blocks of BLOCK_TOKENS.

    doc_ids are the documents that end in the block, in order; the scan doesn't read them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken

        path = public_tokenizers.path(TOKENIZER)
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        file, block, waiting, size, ended = TaskContext.get().partitionId(), 0, [], 0, []
        names = ["file", "block", "data", "doc_ids"]

        def row(tokens: np.ndarray, ids: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.array([tokens.tobytes()], pa.binary()), pa.array([ids], pa.list_(pa.int64()))], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                waiting.append(np.array([*encode(text), END_ID], dtype="<u2"))
                size += len(waiting[-1])
                ended.append((doc_id, block * BLOCK_TOKENS + size))
                while size >= BLOCK_TOKENS:
                    flat = np.concatenate(waiting)
                    stop = (block + 1) * BLOCK_TOKENS
                    yield row(flat[:BLOCK_TOKENS], [d for d, e in ended if e <= stop])
                    ended = [x for x in ended if x[1] > stop]
                    waiting, size, block = [flat[BLOCK_TOKENS:]], size - BLOCK_TOKENS, block + 1
        if size:
            yield row(np.concatenate(waiting), [d for d, _ in ended])

    return texts(documents).mapInArrow(run, "file long, block long, data binary, doc_ids array<long>")


def token_counts(documents: DataFrame) -> DataFrame:
    """(doc_id, file, ordinal, start, n_tokens) of each document of ``documents`` (doc_id, text, ...), counted in its flat files.

    Null and empty texts have no tokens; a very long one lies in several blocks. Rows that tie or repeat a doc_id, or have none, are counted
    each; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    blocks = materialize(flat_files(documents), "tokens", compact=False)
    placed = materialize(_placed(blocks, END_ID, 2), "placed")
    named = blocks.select("file", "block", "doc_ids").join(placed.select("file", "block", "ordinal"), ["file", "block"])
    named = named.select("file", "ordinal", F.posexplode("doc_ids").alias("at", "doc_id")).select("file", (F.col("ordinal") + F.col("at")).alias("ordinal"), "doc_id")
    return _documents(placed).join(named, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
