"""Benchmark passages in training texts through a distributed positional inverted index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.words import SIGN_BREAKS, batch_words, row_slices
from tallyline.session import materialize

WINDOW = 10
#: The term filter sent to the tasks has this many one-byte slots, whatever the size of the benchmark.
FILTER_BITS = 20
#: Parts of a posting list, by document.
LIST_PARTS = 64
_UNUSED = 255


def _lists(row: np.ndarray, rows: int, values: pa.Array) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=rows))))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def item_terms(items: DataFrame, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """``item`` (a key of the row), ``item_id``, ``words`` (term hashes in order) of every benchmark row with a word.

    Words are the runs of digits, letters a-z (A-Z count as such) and non-ASCII characters. Null and empty texts have
    none and give no row; repeated rows are items of their own.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, hashes = batch_words(batch.column(1), SIGN_BREAKS)
            words = _lists(row, batch.num_rows, pa.array(hashes.view(np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), words], names=["item_id", "words"])

    kind = items.schema[id_column].dataType.simpleString()
    split_items = items.select(F.col(id_column).alias("item_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(
        split, f"item_id {kind}, words array<bigint>"
    )
    return materialize(split_items.where("size(words) > 0").withColumn("item", F.monotonically_increasing_id()), "items")


def _windows(terms: DataFrame, window: int) -> DataFrame:
    """``item``, ``at`` (first offset), ``n`` (words of the window), ``words``; windows overlap."""
    last = F.greatest(F.size("words") - window, F.lit(0))
    return (
        terms.withColumn("at", F.explode(F.sequence(F.lit(0), last)))
        .withColumn("n", F.least(F.size("words"), F.lit(window)))
        .select("item", "at", "n", F.slice("words", F.col("at") + 1, F.lit(window)).alias("words"))
    )


def term_filter(terms: DataFrame, window: int = WINDOW) -> np.ndarray:
    """Per slot of a term's hash: the least length of a window that holds a term of the slot, 255 for none.

    At most ``2 ** FILTER_BITS`` small rows reach the driver. Terms that share a slot only let more postings in.
    """
    slot = F.shiftrightunsigned("term", 64 - FILTER_BITS)
    needs = terms.select(F.explode("words").alias("term"), F.least(F.size("words"), F.lit(window)).alias("n"))
    least = needs.groupBy(slot.alias("slot")).agg(F.min("n").cast("int").alias("n")).toPandas()
    table = np.full(1 << FILTER_BITS, _UNUSED, dtype=np.uint8)
    table[least["slot"].to_numpy(np.int64)] = np.minimum(least["n"].to_numpy(np.int64), _UNUSED - 1)
    return table


def _postings(row: np.ndarray, hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Indexes of the words in a run of benchmark terms that is long enough for some window with the term."""
    need = table[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
    used = need != _UNUSED
    edge = np.flatnonzero(np.concatenate(([True], (used[1:] != used[:-1]) | (row[1:] != row[:-1]))))
    length = np.diff(np.concatenate((edge, [len(row)])))
    return np.flatnonzero(used & (np.repeat(length, length) >= need))


def postings(docs: DataFrame, terms: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, carry: bool = False) -> DataFrame:
    """One row per document: ``doc`` (a key of the row), ``doc_id``, ``n_words``, ``term`` and ``pos`` (parallel arrays).

    Only positions that a window could cover are kept: those in a run of benchmark terms at least as long as the
    shortest window with that term. Whole texts are read; a null or empty text has no words. With ``carry`` the whole row
    is kept as ``row``.
    """
    table = docs.sparkSession.sparkContext.broadcast(term_filter(terms, window))

    @F.arrow_udf("struct<n_words:bigint,term:array<bigint>,pos:array<int>>")
    def index(texts: pa.Array) -> pa.Array:
        found = []
        for _, part in row_slices(texts):
            row, hashes = batch_words(part, SIGN_BREAKS)
            count = np.bincount(row, minlength=len(part))
            kept = _postings(row, hashes, table.value) if len(row) else np.empty(0, np.int64)
            pos = kept - np.concatenate(([0], np.cumsum(count)))[row[kept]]
            term = _lists(row[kept], len(part), pa.array(hashes[kept].view(np.int64), pa.int64()))
            place = _lists(row[kept], len(part), pa.array(pos.astype(np.int32), pa.int32()))
            found.append(pa.StructArray.from_arrays([pa.array(count, pa.int64()), term, place], names=["n_words", "term", "pos"]))
        return pa.concat_arrays(found)

    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    texts = docs.select(F.col(f"`{id_column}`").alias("doc_id"), *whole, index(F.col(f"`{text_column}`").cast("string")).alias("found"))
    return materialize(texts.select("*", "found.*").drop("found").withColumn("doc", F.monotonically_increasing_id()), "postings")


def inverted_index(rows: DataFrame) -> DataFrame:
    """``term``, ``doc``, ``pos``: the posting lists, in document order, as a stored table.

    Lists are cut into ``LIST_PARTS`` by document, so that a very common term fills several tasks.
    """
    lists = rows.select("doc", F.inline(F.arrays_zip("term", "pos"))).select("term", "doc", "pos")
    dealt = lists.repartition("term", F.pmod(F.xxhash64("doc"), F.lit(LIST_PARTS)))
    return materialize(dealt.sortWithinPartitions("term", "doc", "pos"), "index")


def _anchors(terms: DataFrame, index: DataFrame, window: int) -> DataFrame:
    """Rarest term of every window all of whose terms are in the index: ``item``, ``a`` (offset), ``term``."""
    frequency = index.groupBy("term").count()
    placed = _windows(terms, window).select("item", "at", "n", F.posexplode("words").alias("o", "term"))
    counted = placed.join(frequency, "term")
    rarest = counted.groupBy("item", "at", "n").agg(
        F.min(F.struct("count", "term", (F.col("at") + F.col("o")).alias("a"))).alias("first"), F.count(F.lit(1)).alias("known")
    )
    return rarest.where("known = n").select("item", "first.a", "first.term").distinct()


def phrase_matches(index: DataFrame, terms: DataFrame, window: int = WINDOW) -> DataFrame:
    """Exact phrase matches: ``doc``, ``item``, ``item_id``, ``start``, ``stop`` (word positions, end exclusive).

    Each window of ``window`` consecutive item words (or the whole shorter item) is sought from its rarest term: that
    term's posting list, moved by the term's offset, gives the places where the item could lie, and only there are the
    lists of the words around it intersected. Overlapping windows of one place come out as one span.
    """
    anchors = _anchors(terms, index, window)
    offsets = terms.select("item", F.size("words").alias("size"), F.col("words"))
    around = anchors.join(offsets, "item").select(
        "item",
        "a",
        "term",
        F.transform(
            F.sequence(F.greatest(F.col("a") - (window - 1), F.lit(0)), F.least(F.col("a") + (window - 1), F.col("size") - 1)),
            lambda o: F.struct(o.alias("o"), F.element_at("words", o + 1).alias("term")),
        ).alias("near"),
    )
    places = around.join(index, "term").select("item", "doc", (F.col("pos") - F.col("a")).alias("diag"), F.inline("near"))
    wanted = places.where("diag + o >= 0").distinct().withColumn("pos", F.col("diag") + F.col("o"))
    met = wanted.join(index, ["doc", "pos", "term"], "left_semi")
    run = F.col("o") - F.row_number().over(Window.partitionBy("item", "doc", "diag").orderBy("o"))
    spans = met.withColumn("run", run).groupBy("item", "doc", "diag", "run").agg(F.min("o").alias("o"), F.count(F.lit(1)).alias("n"))
    named = spans.join(terms.select("item", "item_id", F.least(F.size("words"), F.lit(window)).alias("least")), "item")
    start = F.col("diag") + F.col("o")
    return named.where("n >= least").select("doc", "item", "item_id", start.alias("start"), (start + F.col("n")).cast("int").alias("stop"))


def proximity_matches(index: DataFrame, terms: DataFrame, window: int = WINDOW, slop: int = 5, share: float = 0.8) -> DataFrame:
    """Windows whose terms lie close together in any order: ``doc``, ``item``, ``item_id``, ``at``, ``pos``, ``n_terms``.

    ``pos`` is a place of one of the window's terms with at least ``share`` of the window's distinct terms within
    ``window + slop`` words on either side; of places that close in one document the first is given. A match may lack
    some terms, so each window is sought from as many of its rarest terms, and one more: a match holds one of them. Terms
    that the index lacks count as the rarest. The index keeps benchmark terms in long runs only; build it with
    ``window=1`` to have every position of every benchmark term.
    """
    frequency = index.groupBy("term").count()
    windows = _windows(terms, window).withColumn("wanted", F.array_distinct("words"))
    least = F.ceil(F.size("wanted") * F.lit(share))
    counted = windows.select("item", "at", "wanted", F.explode("wanted").alias("term")).join(frequency, "term", "left")
    rarest = counted.groupBy("item", "at", "wanted").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "term"))).alias("terms"))
    sought = rarest.select("item", "at", "wanted", F.explode(F.slice("terms", F.lit(1), (F.size("wanted") - least + 1).cast("int"))).alias("t"))
    sought = sought.where("t.count > 0").select("item", "at", "wanted", F.col("t.term").alias("term"))
    # What lies around a place is gathered once, however many windows are sought there.
    reach = window + slop
    places = index.join(sought.select("term").distinct(), "term", "left_semi").select("doc", "pos")
    spots = places.withColumn("spot", F.explode(F.sequence(F.col("pos") - reach, F.col("pos") + reach)))
    around = spots.join(index.select("doc", F.col("pos").alias("spot"), F.col("term").alias("seen")), ["doc", "spot"])
    around = around.groupBy("doc", "pos").agg(F.collect_set("seen").alias("seen"))
    seeds = index.join(around, ["doc", "pos"]).join(sought, "term")
    close = seeds.withColumn("n_terms", F.size(F.array_intersect("wanted", "seen")).cast("bigint")).where(F.col("n_terms") >= least)
    before = F.lag("pos").over(Window.partitionBy("item", "at", "doc").orderBy("pos"))
    first = close.withColumn("gap", F.col("pos") - before).where(F.col("gap").isNull() | (F.col("gap") > reach))
    return first.join(terms.select("item", "item_id"), "item").select("doc", "item", "item_id", "at", "pos", "n_terms")


def hit_summary(spans: DataFrame) -> DataFrame:
    """Per ``doc``: ``n_hit`` (words inside any span, once), ``n_items``, ``item_ids`` (sorted as strings)."""
    order = Window.partitionBy("doc").orderBy("start", "stop")
    covered = F.coalesce(F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.greatest(F.col("stop") - F.greatest("start", covered), F.lit(0))
    items = F.sort_array(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit(""))))
    return (
        spans.withColumn("own", own)
        .groupBy("doc")
        .agg(F.sum("own").cast("bigint").alias("n_hit"), items.alias("item_ids"))
        .withColumn("n_items", F.size("item_ids").cast("bigint"))
    )


def items_digest(item_ids: Column) -> Column:
    """SHA-256 of the comma-joined ids; without ids, that of the empty text."""
    return F.sha2(F.coalesce(F.concat_ws(",", item_ids), F.lit("")), 256)


def contamination(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``item_ids``, ``contaminated`` for every row of ``docs``.

    Null and empty texts have no words and no hits; repeated rows and ids are rows of their own; an empty benchmark
    leaves all rows clean; other columns are ignored. Items with one id count once.
    """
    terms = item_terms(items)
    rows = postings(docs, terms, id_column, text_column, window)
    hits = hit_summary(phrase_matches(inverted_index(rows), terms, window))
    none = F.lit(0).cast("bigint")
    return (
        rows.select("doc", "doc_id", "n_words")
        .join(hits, "doc", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", none).alias("n_hit"),
            F.coalesce("n_items", none).alias("n_items"),
            F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
            F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        )
    )


def proximity(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """``doc_id``, ``n_near`` (matches of ``proximity_matches``), ``near_items`` (sorted as strings) for every row of ``docs``.

    The index has every position of every benchmark term. Null and empty texts have no matches; repeated rows and ids are
    rows of their own.
    """
    terms = item_terms(items)
    rows = postings(docs, terms, id_column, text_column, window=1)
    found = proximity_matches(inverted_index(rows), terms, window)
    names = F.sort_array(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit(""))))
    hits = found.groupBy("doc").agg(F.count(F.lit(1)).alias("n_near"), names.alias("near_items"))
    none = F.array().cast("array<string>")
    return rows.select("doc", "doc_id").join(hits, "doc", "left").select("doc_id", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.coalesce("near_items", none).alias("near_items"))


def clean_documents(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, with all their columns.

    Null and empty texts are clean; rows are told apart by place, so repeated rows and null ids stay as they are.
    """
    terms = item_terms(items)
    rows = postings(docs, terms, id_column, text_column, window, carry=True)
    hit = phrase_matches(inverted_index(rows), terms, window).select("doc").distinct()
    return rows.join(hit, "doc", "left_anti").select("row.*")
