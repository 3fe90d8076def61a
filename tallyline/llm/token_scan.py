"""Token counts per document from flat token files that have no index: only end-of-document ids tell where texts end."""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm.prefix import running_totals
from tallyline.session import materialize, scratch_path

#: Public vocabulary with 50,256 ids; the next one is free and ends documents.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
END_OF_DOCUMENT = 50256
TOKEN_TYPE = "<u2"
BLOCK_TOKENS = 1 << 20
# Fixed value: how the vocabulary's authors cut texts into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(vocabulary: str, pieces: str) -> tiktoken.Encoding:
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("tokens", pat_str=pieces, mergeable_ranks=ranks, special_tokens={})


def encode(text: str | None, vocabulary: str = VOCABULARY, pieces: str = PIECES) -> np.ndarray:
    """Token ids of a whole text; lone surrogates count as the replacement character."""
    return np.array(_encoding(vocabulary, pieces).encode_ordinary((text or "").encode("utf-8", "replace").decode("utf-8")), dtype=np.uint32)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path) if ":/" in path else f"file://{path}")


def write_token_files(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Write one flat file per task below ``path``; returns the stored list ``file``, ``place``, ``doc_id`` of what went where.

    A document is its ids, two bytes each, and the end id; null and empty texts are an end id alone. A file gets its name
    when it is whole, so a repeated task replaces equal bytes and a lost one leaves a hidden draft that nobody reads.
    A token whose id is that of the end or above, as other vocabularies have them, is an error.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(path)
        name, draft, out, place = f"part-{TaskContext.get().partitionId():06d}.tokens", f"{base}/.{uuid.uuid4().hex}", None, 0
        for batch in batches:
            if out is None:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(draft)
            for text in batch.column(1):
                ids = encode(text.as_py(), vocabulary)
                if len(ids) and ids.max() >= END_OF_DOCUMENT:
                    raise ValueError(f"the vocabulary has ids from {END_OF_DOCUMENT} on, which ends documents: {vocabulary}")
                out.write(np.append(ids, END_OF_DOCUMENT).astype(TOKEN_TYPE).tobytes())
            places = pa.array(range(place, place + batch.num_rows), pa.int64())
            place += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([name] * batch.num_rows), places, batch.column(0)], names=["file", "place", "doc_id"])
        if out is not None:
            out.close()
            store.move(draft, f"{base}/{name}")

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    return materialize(rows.mapInArrow(write, f"file string, place bigint, doc_id {kind}"), "token-list")


def scan_blocks(spark: SparkSession, path: str, end: int = END_OF_DOCUMENT, token_type: str = TOKEN_TYPE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Stored rows ``file``, ``block``, ``tokens``, ``ends`` (places of end ids in the file), one per block of every file.

    Spark lists the files and deals out blocks, so one large file is read by many tasks. A block is searched with one
    comparison over its array of ids. A file that is no whole number of ids raises.
    """
    width = np.dtype(token_type).itemsize
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").where("length > 0")
    step = block_tokens * width
    blocks = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(step).cast("bigint"))).alias("at"))
    dealt = blocks.repartition("path", "at").select("path", "at", F.least(F.lit(step).cast("bigint"), F.col("length") - F.col("at")).alias("size"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at, size in zip(*(column.to_pylist() for column in batch.columns)):
                if size % width:
                    raise ValueError(f"{name} is no whole number of {width}-byte ids")
                store, inner = _store(name)
                with store.open_input_file(inner) as file:
                    ids = np.frombuffer(file.read_at(size, at), dtype=token_type)
                ends = np.flatnonzero(ids == end) + at // width
                row = [pa.array([name.rpartition("/")[2]]), pa.array([at // step]), pa.array([len(ids)], pa.int64()), pa.array([ends.tolist()], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(row, names=["file", "block", "tokens", "ends"])

    return materialize(dealt.mapInArrow(scan, "file string, block bigint, tokens bigint, ends array<bigint>"), "blocks")


def document_tokens(blocks: DataFrame) -> DataFrame:
    """``file``, ``place`` (number of the document in its file), ``first`` (place of its first id), ``n_tokens``, ``ended``.

    A document may begin many blocks before its end. The last end before each block and the number of ends before it come
    from a prefix scan over all blocks, so a block needs to know nothing else of its neighbours. Ids after the last end of
    a file are a document that has not ended.
    """
    last = F.when(F.size("ends") > 0, F.struct("file", F.element_at("ends", -1).alias("at")))
    scanned = running_totals(blocks, ["file", "block"], {"before": F.size("ends").cast("bigint")}, {"last": last})
    scanned = materialize(scanned, "scanned")
    starts = scanned.groupBy("file").agg(F.min("before").alias("base"), F.sum("tokens").alias("size"), F.sum(F.size("ends")).alias("n"), F.max(F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1)).alias("final"))
    opened = F.when(F.col("last.file") == F.col("file"), F.col("last.at")).otherwise(F.lit(-1).cast("bigint"))
    cut = scanned.join(starts.select("file", "base"), "file").select("file", (F.col("before") - F.col("base")).alias("ahead"), opened.alias("opened"), "ends")
    ended = cut.select("file", "ahead", F.array_insert("ends", 1, F.col("opened")).alias("cuts"), F.posexplode("ends").alias("k", "stop")).select(
        "file",
        (F.col("ahead") + F.col("k")).alias("place"),
        (F.get("cuts", F.col("k")) + 1).alias("first"),
        (F.col("stop") - F.get("cuts", F.col("k")) - 1).alias("n_tokens"),
        F.lit(True).alias("ended"),
    )
    begun = F.coalesce(F.col("final") + 1, F.lit(0).cast("bigint"))
    rest = starts.where(F.col("size") > begun).select("file", F.col("n").cast("bigint").alias("place"), begun.alias("first"), (F.col("size") - begun).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionByName(rest)


def token_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``doc_id``, ``n_tokens`` for every row, counted by scanning the token files written from ``docs``.

    Null and empty texts have no tokens; repeated rows are rows of their own; other columns are ignored; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    listed = write_token_files(docs, path, id_column, text_column, vocabulary)
    if not listed.take(1):
        return listed.select("doc_id", F.lit(0).cast("bigint").alias("n_tokens"))
    counted = document_tokens(scan_blocks(spark, path, block_tokens=block_tokens))
    return listed.join(counted, ["file", "place"]).select("doc_id", "n_tokens")
