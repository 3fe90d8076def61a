"""One output file per row, written by the executors."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def resolved_root(spark: SparkSession, root: str) -> str:
    """``root`` with its scheme: one without belongs to the session's default file system, as in Spark's own readers."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return re.sub("^file:/+", "file:///", system.makeQualified(path).toString().rstrip("/"))


def _writer(root: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        made: set[str] = set()
        for batch in batches:
            paths, sizes, digests = batch.column(0).to_pylist(), [], []
            # One content at a time becomes a Python object.
            for path, value in zip(paths, batch.column(1)):
                content = value.as_py()
                target = f"{base}/{path}"
                folder = target.rsplit("/", 1)[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                # A lost or repeated task leaves whole files only: the rename is the commit.
                draft = f"{folder}/.{uuid.uuid4().hex}.tmp"
                with store.open_output_stream(draft) as out:
                    out.write(content)
                store.move(draft, target)
                sizes.append(len(content))
                digests.append(hashlib.sha256(content).hexdigest())
            columns = [pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "bytes", "sha256"])

    return write


_WRITTEN = "path string, bytes long, sha256 string"


def _files(df: DataFrame, path: Column, content: Column) -> DataFrame:
    """(``path``, ``content``) of every row; two rows with one path are an error."""
    rows = df.select(path.cast("string").alias("path"), content.cast("binary").alias("content"))
    twice = rows.groupBy("path").count().where("count > 1").take(1)
    if twice:
        raise ValueError(f"more than one row would be written to {twice[0]['path']}")
    return rows


def write_files(df: DataFrame, root: str, path: Column, content: Column) -> tuple[int, int]:
    """Write ``content`` (text or bytes) to ``root``/``path`` for every row.

    Runs at once and in parallel; folders are kept. Returns the number of files
    and bytes. Two rows with one path are an error before anything is written;
    that look at the paths is the only shuffle. ``root`` may be in any file
    system that pyarrow opens and all executors reach. Files appear one by one;
    :func:`write_tree` replaces a folder as a whole.
    """
    rows = _files(df, path, content)
    written = rows.mapInArrow(_writer(resolved_root(df.sparkSession, root)), _WRITTEN)
    total = written.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    return total["files"], total["bytes"]


#: The folder of a tree that lists its files.
MANIFEST = "_manifest"
_STAGED, _OLD = "._staged-", "._old"


class _Folder:
    """Renames and removals in the file system of ``root``: all that the driver does with a tree."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = resolved_root(spark, root)
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._system = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, suffix: str = "") -> bool:
        return self._system.exists(self._path(self.root + suffix))

    def remove(self, suffix: str) -> None:
        self._system.delete(self._path(self.root + suffix), True)

    def rename(self, suffix: str, to: str) -> None:
        if not self._system.rename(self._path(self.root + suffix), self._path(self.root + to)):
            raise OSError(f"cannot rename {self.root}{suffix} to {self.root}{to}")

    def recover(self) -> None:
        """Finish or undo what an earlier writer was stopped in: a tree set aside comes back unless another is in its place."""
        if self.exists(_OLD):
            if self.exists():
                self.remove(_OLD)
            else:
                self.rename(_OLD, "")


def write_tree(df: DataFrame, root: str, path: Column, content: Column) -> tuple[int, int]:
    """Replace the folder ``root`` by the files ``path`` with ``content`` (text or bytes) and a manifest of them.

    The files are staged beside ``root`` and listed as they are written (``_manifest``: path, bytes, sha256 of each);
    only when all are there do two renames put the new tree in the place of the old one. A job that fails leaves the old
    tree as it was and its own staged files removed; a driver that is killed between the renames leaves the old tree
    aside, from where the next write, or :func:`read_manifest`, brings it back. Writing the same rows again gives the same
    tree. Returns the number of files and bytes. One writer at a time; paths that begin with ``_manifest/`` are an error.
    """
    spark = df.sparkSession
    rows = _files(df, path, content)
    if rows.where(F.col("path").startswith(MANIFEST + "/")).take(1):
        raise ValueError(f"{MANIFEST} is not a name for files")
    folder, staged = _Folder(spark, root), f"{_STAGED}{uuid.uuid4().hex}"
    folder.recover()
    try:
        rows.mapInArrow(_writer(folder.root + staged), _WRITTEN).write.parquet(f"{folder.root}{staged}/{MANIFEST}")
        total = spark.read.parquet(f"{folder.root}{staged}/{MANIFEST}").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    except BaseException:
        folder.remove(staged)
        raise
    if folder.exists():
        folder.rename("", _OLD)
    folder.rename(staged, "")
    folder.remove(_OLD)
    return total["files"], total["bytes"]


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """(``path``, ``bytes``, ``sha256``) of the files of a tree written by :func:`write_tree`."""
    folder = _Folder(spark, root)
    folder.recover()
    return spark.read.schema(_WRITTEN).parquet(f"{folder.root}/{MANIFEST}")


def tree_contents(spark: SparkSession, root: str) -> DataFrame:
    """(``path``, ``bytes``, ``sha256``, ``content``) of the files of some bytes that are in a tree, its manifest left out."""
    base = resolved_root(spark, root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    below = F.substring(F.col("path"), F.instr("path", base.split("://")[-1].rstrip("/") + "/") + F.lit(len(base.split("://")[-1]) + 1), F.lit(2**31 - 1))
    named = files.select(below.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), "content")
    return named.where(~F.col("path").startswith(MANIFEST + "/"))


def tree_faults(spark: SparkSession, root: str) -> DataFrame:
    """Files in which manifest and tree differ: (path, fault), ``missing``, ``unlisted`` or ``changed``. Contents stay where they are read.

    Spark's readers pass over files without a byte, so those are not checked.
    """
    listed = read_manifest(spark, root).where("bytes > 0").select("path", F.col("sha256").alias("listed"))
    found = tree_contents(spark, root).select("path", F.col("sha256").alias("found"))
    fault = F.when(F.col("found").isNull(), "missing").when(F.col("listed").isNull(), "unlisted").when(F.col("listed") != F.col("found"), "changed")
    return listed.join(found, "path", "full_outer").select("path", fault.alias("fault")).where("fault is not null")
