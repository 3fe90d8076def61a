"""Quoted CSV files read block by block, with line breaks inside quotes.

Spark cuts large files into blocks at line ends. Whether a line starts inside quotes depends on the number of quotes
before it, in all earlier blocks of the file. So a first pass, in the JVM, counts the quotes of each block; a running
sum over a file's blocks, one row each, tells for every block whether it starts inside quotes. Knowing that, each task
joins the lines of its block to pieces that start and end outside quotes. Only a piece cut by a block's edge needs other
blocks: these are sought in the blocks that have one, and put together by file and first block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyline.operators.joins import fits_broadcast
from tallyline.session import materialize

_QUOTE = 34
_PIECES = "file bigint, block bigint, at bigint, value binary, head boolean, tail boolean, odd boolean"


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(``path``, ``file``, ``block``, ``value``) of every line, as bytes without its line feed; ``file`` is a hash of the path."""
    raw = spark.read.option("lineSep", "\n").text(path)
    place = [F.col("_metadata.file_path").alias("path"), F.xxhash64(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return raw.select(*place, F.col("value").cast("binary").alias("value"))


def block_facts(lines: DataFrame) -> DataFrame:
    """One stored row per block: ``path``, ``file``, ``block``, ``odd`` (starts inside quotes), ``open`` (ends there), ``first`` (line).

    One pass over the lines, whose counts are added up before they move; the running sum sees a row per block.
    """
    text = F.col("value").cast("string")
    quotes = F.octet_length("value") - F.octet_length(F.replace(text, F.lit('"'), F.lit("")))
    counted = lines.withColumn("row", F.monotonically_increasing_id()).groupBy("path", "file", "block")
    blocks = counted.agg(F.sum(quotes).alias("quotes"), F.min_by(F.when(F.col("block") == 0, F.col("value")), "row").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    so_far = blocks.withColumn("before", F.coalesce(F.sum("quotes").over(before), F.lit(0)))
    odd = F.col("before") % 2 == 1
    return materialize(so_far.select("path", "file", "block", odd.alias("odd"), ((F.col("before") + F.col("quotes")) % 2 == 1).alias("open"), "first"), "csv-blocks")


class _Block:
    """The lines of one block, joined to pieces as they come in; what is still open waits."""

    def __init__(self, file: int, block: int, odd: bool):
        self.file, self.block, self.starts_odd, self.odd = file, block, odd, odd
        self.at, self.waiting = 0, []

    def _pieces(self, values: pa.Array, tail: bool = False) -> pa.RecordBatch:
        n = len(values)
        at = np.arange(self.at, self.at + n)
        head = (at == 0) & self.starts_odd
        self.at += n
        columns = [
            pa.array(np.full(n, self.file)), pa.array(np.full(n, self.block)), pa.array(at), values, pa.array(head), pa.array(np.full(n, tail)),
            pa.array(np.full(n, self.starts_odd)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["file", "block", "at", "value", "head", "tail", "odd"])

    def add(self, lines: pa.Array) -> Iterator[pa.RecordBatch]:
        offsets = np.frombuffer(lines.buffers()[1], dtype=np.int32)[lines.offset : lines.offset + len(lines) + 1]
        raw = np.frombuffer(lines.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        upto = np.searchsorted(np.flatnonzero(raw == _QUOTE), offsets - offsets[0])
        inside = (upto + self.odd) % 2 == 1
        starts = np.flatnonzero(~inside[:-1])
        self.odd = bool(inside[-1])
        first = int(starts[0]) if len(starts) else len(lines)
        self.waiting += lines[:first].to_pylist()
        if not len(starts):
            return
        if self.waiting:
            yield self._pieces(pa.array([b"\n".join(self.waiting)], pa.binary()))
            self.waiting = []
        bounds = np.concatenate((starts, [len(lines)])) - first
        grouped = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), lines[first:])
        joined = pa.compute.binary_join(grouped, b"\n")
        if self.odd:
            self.waiting = lines[int(starts[-1]) :].to_pylist()
            joined = joined[:-1]
        if len(joined):
            yield self._pieces(joined)

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.waiting:
            yield self._pieces(pa.array([b"\n".join(self.waiting)], pa.binary()), self.odd)


def _joined(edges: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pieces of the lines (``file``, ``block``, ``value``, ``odd``) of whole blocks: those cut by a block's edge, or all others.

    Where ``odd`` is null both cases are tried.
    """

    def wanted(batch: pa.RecordBatch) -> pa.RecordBatch:
        cut = pa.compute.or_(batch["head"], batch["tail"])
        return batch.filter(cut if edges else pa.compute.invert(cut))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list[_Block] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            file, block = (batch.column(k).to_numpy() for k in (0, 1))
            cuts = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if not now or (now[0].file, now[0].block) != (file[a], block[a]):
                    for ended in now:
                        yield from map(wanted, ended.end())
                    odd = batch.column(3)[a].as_py()
                    now = [_Block(int(file[a]), int(block[a]), o) for o in ((False, True) if odd is None else (odd,))]
                for each in now:
                    yield from map(wanted, each.add(batch.column(2).slice(a, b - a)))
        for ended in now:
            yield from map(wanted, ended.end())

    return run


def outside_quotes(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """(``file``, ``block``, ``at``, ``value``): the lines joined to pieces that start outside quotes and end there.

    ``at`` numbers a block's pieces from 0. A piece over several blocks belongs to the first of them; one that is open at
    the end of its file ends there. Lines never move but for the pieces that a block's edge cuts. The list of blocks is
    sent to the tasks if its counted size allows it; else each block is joined in both ways, and the wrong one dropped
    afterwards by a join.
    """
    known = blocks.select("file", "block", "odd", "open")
    sent = fits_broadcast(known)

    def pieces(source: DataFrame, edges: bool) -> DataFrame:
        found = source.select("file", "block", "value", "odd").mapInArrow(_joined(edges), _PIECES)
        return found if sent else found.join(known.select("file", "block", "odd"), ["file", "block", "odd"])

    own = lines.select("file", "block", "value")
    told = own.join(F.broadcast(known), ["file", "block"]) if sent else own.withColumn("odd", F.lit(None).cast("boolean"))
    inner = pieces(told, False)
    cut = pieces(told.where("odd or open") if sent else told, True)
    so_far = Window.partitionBy("file").orderBy("block", "at")
    chain = F.max(F.when(~F.col("head"), F.struct("block", "at"))).over(so_far)
    parts = cut.withColumn("chain", chain).groupBy("file", "chain").agg(F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["value"].cast("string")), "\n").cast("binary")
    return inner.select("file", "block", "at", "value").unionByName(parts.select("file", "chain.block", "chain.at", text.alias("value")))
