"""Reports over extracted lineage: summaries, table maps, per-file texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.arrays import explode_items, sorted_set
from tallyline.functions.text import csv_field
from tallyline.operators.joins import skewed_lookup
from tallyline.operators.numbering import number_rows
from tallyline.operators.lineage import role_entries
from tallyline.session import gather, too_few_partitions

LIST_SEPARATOR = "; "
BANNER = "=" * 60
_MERGE_SALTS = 64


def joined(items: Column) -> Column:
    """A set in name order as ``a; b; c``."""
    return F.array_join(sorted_set(items), LIST_SEPARATOR)


def file_summary(extracted: DataFrame, key: str = "name", extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per script with its tables; ``extra`` columns of the frame are appended."""
    return extracted.select(
        F.col(key).alias("file_name"),
        joined(F.col("sources")).alias("source_tables"),
        joined(F.col("targets")).alias("target_tables"),
        *extra,
    )


def _united(rows: DataFrame, keys: list[str], *lists: str, tasks: int | None = None) -> DataFrame:
    """The union of each list column per key, in two stages.

    Equal rows fall together before the first shuffle, its groups are salted by
    their lists, and only the salted unions meet in the second stage, so a key
    held by a large share of the rows is worked on by many tasks. Where ``tasks``
    are more than that shuffle has, rows move before equal ones have fallen
    together, so those of a key with equal lists are dealt by their path as well.
    """
    moved = too_few_partitions(rows.sparkSession, tasks) and "path" in rows.columns
    told = [*lists, "path"] if moved else lists
    salted = rows.select(*keys, *lists, F.pmod(F.xxhash64(*told), F.lit(_MERGE_SALTS)).alias("_salt"))
    partial = gather(salted, tasks, *keys, "_salt").groupBy(*keys, "_salt").agg(
        *[F.array_distinct(F.flatten(F.collect_set(c))).alias(c) for c in lists]
    )
    return gather(partial, tasks, *keys).groupBy(*keys).agg(*[sorted_set(F.flatten(F.collect_list(c))).alias(c) for c in lists])


def _map(extracted: DataFrame, one: str, other: str, key: str, tasks: int | None) -> DataFrame:
    """(program, table, others): each table of ``one`` with the ``other`` tables of its program.

    Only one side is exploded, so no table pairs are formed. Scripts keyed by
    path need no merging and no shuffle; scripts sharing a name are united.
    """
    path = ["path"] if "path" in extracted.columns else []
    rows = explode_items(extracted.select(F.col(key).alias("program"), *path, one, other), one, "table")
    if key == "path":
        return rows.select("program", "table", sorted_set(F.col(other)).alias("others"))
    return _united(rows, ["program", "table"], other, tasks=tasks).withColumnRenamed(other, "others")


def source_map(extracted: DataFrame, key: str = "name", tasks: int | None = None) -> DataFrame:
    """Every source table, per program, with the targets of that program."""
    rows = _map(extracted, "sources", "targets", key, tasks)
    return rows.select(
        "program", F.col("table").alias("source_table"), F.array_join("others", LIST_SEPARATOR).alias("target_tables")
    )


def target_map(extracted: DataFrame, key: str = "name", tasks: int | None = None) -> DataFrame:
    """Every target table, per program, with the sources of that program."""
    rows = _map(extracted, "targets", "sources", key, tasks)
    return rows.select(
        "program", F.col("table").alias("target_table"), F.array_join("others", LIST_SEPARATOR).alias("source_tables")
    )


def distinct_sources(extracted: DataFrame) -> DataFrame:
    """Every source table of the corpus once."""
    return explode_items(extracted.select("sources"), "sources", "source_table").distinct()


def lineage_counts(extracted: DataFrame) -> DataFrame:
    """Number of scripts, of distinct source tables and of distinct target tables.

    Each script adds one entry for itself beside its tables, so one pass and one
    shuffle of already combined entries give all three numbers.
    """
    itself = F.array(F.struct(F.lit("file").alias("role"), F.lit("").alias("table")))
    entries = extracted.select(F.concat(itself, role_entries()).alias("_entries"))
    counted = explode_items(entries, "_entries", "_entry").groupBy("_entry").agg(F.count(F.lit(1)).alias("n"))
    role = F.col("_entry.role")
    return counted.agg(
        F.coalesce(F.sum(F.when(role == "file", F.col("n"))), F.lit(0)).alias("files"),
        F.count_if(role == "source").alias("source_tables"),
        F.count_if(role == "target").alias("target_tables"),
    )


def _listed(items: Column, none: str | None = None) -> Column:
    """Every item on a line of its own, or a line saying there is none."""
    lines = F.concat(F.array_join(items, "\n"), F.lit("\n"))
    return F.when(F.size(items) > 0, lines).when(F.size(items) == 0, F.lit("" if none is None else none + "\n"))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def file_text(extracted: DataFrame) -> DataFrame:
    """(path, content): the sorted tables of each script as text."""
    return extracted.select(
        "path",
        _text(
            "[Source Tables]\n", _listed(sorted_set(F.col("sources"))),
            "\n[Target Tables]\n", _listed(sorted_set(F.col("targets"))),
        ).alias("content"),
    )


def numbered_text(extracted: DataFrame, *, root: str = "", labels: tuple[str, str] = ("[Target Tables]", "[Source Tables]")) -> DataFrame:
    """(path, content): numbered targets, then numbered sources, in the order found."""

    def section(label: str, items: str, end: str) -> Column:
        lines = F.transform(
            F.col(items), lambda t, i: _text("  ", (i + 1).cast("string"), ". ", t, "\n")
        )
        body = _text(label, "\n", F.array_join(lines, ""), end)
        return F.when(F.size(items) > 0, body).otherwise("")

    none = (F.size("sources") == 0) & (F.size("targets") == 0)
    tables = _text(section(labels[0], "targets", "\n"), section(labels[1], "sources", ""))
    content = _text(f"FILE: {root}", F.col("path"), "\n\n", F.when(none, F.lit("(추출된 테이블 없음)\n")).otherwise(tables))
    return extracted.select("path", content.alias("content"))


def step_text(step_name: Column, sources: Column, targets: Column, style: str = "file") -> Column:
    """The tables of one step as text.

    ``file``     sorted, as written to the per-script step file
    ``detail``   sorted, as held in the step summary
    ``console``  in the order found, indented step name
    """
    if style != "console":
        sources, targets = sorted_set(sources), sorted_set(targets)
    reads, changes = _listed(sources, "(No source tables)"), _listed(targets, "(No target tables)")
    if style == "detail":
        return _text(f"{BANNER}\n", step_name, f"\n{BANNER}\n[Source Tables]\n", reads, "\n[Target Tables]\n", changes)
    indent = " " if style == "console" else ""
    return _text(
        f"{BANNER}\n{indent}", step_name, f"\n{BANNER}\n\n[Source Tables]\n", reads,
        "\n[Target Tables]\n", changes, "\n",
    )


def _step_entry() -> Column:
    """What a step's text is made of; the text itself is made where the steps have come together."""
    return F.when(F.col("step").isNotNull(), F.struct("step_ord", "step", "sources", "targets"))


def _steps_in_order(entries: Column, style: str, separator: str) -> Column:
    texts = F.transform(F.array_sort(entries), lambda e: step_text(e["step"], e["sources"], e["targets"], style))
    return F.array_join(texts, separator)


def step_files(rows: DataFrame, style: str = "file", tasks: int | None = None) -> DataFrame:
    """(path, content): the step texts of each script, one after another; ``rows`` come from ``step_rows``.

    ``tasks``, here and in the other reports, is the number of tasks that write
    the report where ``spark.sql.shuffle.partitions`` are too few for the rows.
    """
    return gather(rows, tasks, "path").groupBy("path").agg(F.collect_list(_step_entry()).alias("_entries")).select(
        "path", _steps_in_order(F.col("_entries"), style, "").alias("content")
    )


def step_summary(rows: DataFrame, key: str = "name", tasks: int | None = None) -> DataFrame:
    """One row per script: united tables, step texts and the number of steps; ``rows`` come from ``step_rows``.

    With ``key="name"`` scripts of the same name share a row, their steps in
    path order. Such a row holds the steps of all of them; where a name may be
    that of very many scripts, :func:`step_report_lines` gives the same report
    without ever building the row.
    """
    per_file = gather(rows, tasks, "path", "name").groupBy("path", "name").agg(
        sorted_set(F.flatten(F.collect_set("sources"))).alias("sources"),
        sorted_set(F.flatten(F.collect_set("targets"))).alias("targets"),
        F.collect_list(_step_entry()).alias("_entries"),
        F.count("step").alias("total_steps"),
    )
    if key == "name":
        per_name = gather(per_file, tasks, "name").groupBy("name").agg(
            sorted_set(F.flatten(F.collect_set("sources"))).alias("sources"),
            sorted_set(F.flatten(F.collect_set("targets"))).alias("targets"),
            F.array_sort(F.collect_list(F.when(F.size("_entries") > 0, F.struct("path", "_entries")))).alias("_files"),
            F.sum("total_steps").alias("total_steps"),
        )
        texts = F.transform("_files", lambda f: _steps_in_order(f["_entries"], "detail", "\n\n"))
        per_file = per_name.withColumn("steps", F.array_join(texts, "\n\n"))
    else:
        per_file = per_file.withColumn("steps", _steps_in_order(F.col("_entries"), "detail", "\n\n"))
    return per_file.select(
        F.col(key).alias("file_name"),
        F.array_join("sources", LIST_SEPARATOR).alias("source_tables"),
        F.array_join("targets", LIST_SEPARATOR).alias("target_tables"),
        "steps",
        "total_steps",
    )


def step_report_lines(step_rows: DataFrame, key: str = "name", tasks: int | None = None) -> DataFrame:
    """The CSV records of :func:`step_summary`, cut into pieces that keep one step each.

    Columns ``file_name``, ``path``, ``step_ord``, ``value``: written as text
    lines in the order of the first three, the pieces are the records. No group
    is gathered: per file name only its united tables, its number of steps and
    its first and last step are aggregated and looked up again. The rows are
    read three times, so hand in a stored frame.
    """
    return _report_lines(_report_rows(step_rows, key, tasks))


def _report_rows(step_rows: DataFrame, key: str, tasks: int | None) -> DataFrame:
    """What the pieces of the records are made of: the steps, and what their record begins and ends with where it does."""
    rows = step_rows.withColumn("file_name", F.col(key)).withColumn("_at", F.struct("path", "step_ord"))
    is_step = F.col("step").isNotNull()
    spans = rows.groupBy("file_name").agg(
        F.min(F.when(is_step, F.col("_at"))).alias("_first"),
        F.max(F.when(is_step, F.col("_at"))).alias("_last"),
        F.min("_at").alias("_only"),
        F.count("step").alias("_total"),
    )
    lists = _united(rows, ["file_name"], "sources", "targets", tasks=tasks)
    frames = spans.join(lists, "file_name").withColumnsRenamed({"sources": "_all_sources", "targets": "_all_targets"})
    marked = skewed_lookup(rows, frames, "file_name").withColumns({
        "_opens": F.col("_at") == F.col("_first"),
        "_closes": F.col("_at") == F.col("_last"),
        "_bare": ~is_step & F.col("_first").isNull() & (F.col("_at") == F.col("_only")),
    })
    begins = F.col("_opens") | F.col("_bare")
    return marked.select(
        "file_name", "path", "step_ord", "step", "sources", "targets", "_opens", "_closes", "_bare", "_total",
        *[F.when(begins, F.col(c)).alias(c) for c in ("_all_sources", "_all_targets")],
    )


def _report_lines(rows: DataFrame) -> DataFrame:
    """(file_name, path, step_ord, value): the pieces as text; no row moves."""
    opening = F.concat(
        csv_field(F.col("file_name")), F.lit(","), csv_field(F.array_join("_all_sources", LIST_SEPARATOR)), F.lit(","),
        csv_field(F.array_join("_all_targets", LIST_SEPARATOR)), F.lit(","),
    )
    text = F.replace(step_text(F.col("step"), F.col("sources"), F.col("targets"), "detail"), F.lit('"'), F.lit('""'))
    written = rows.withColumn("_text", F.when(F.col("step").isNotNull(), text))
    body = F.concat(
        F.when(F.col("_opens"), F.concat(opening, F.lit('"'))).otherwise(F.lit("")),
        # A step text ends with a line break, which the text sink writes after each piece.
        F.left("_text", F.char_length("_text") - 1),
        F.when(F.col("_closes"), F.concat(F.lit('\n",'), F.col("_total").cast("string"))).otherwise(F.lit("\n\n")),
    )
    value = F.when(F.col("step").isNotNull(), body).otherwise(F.when(F.col("_bare"), F.concat(opening, F.lit(",0"))))
    return written.select("file_name", "path", "step_ord", value.alias("value")).where(F.col("value").isNotNull())


#: Characters of a piece at most.
PIECE_CHARS = 16_384


def bounded_pieces(
    lines: DataFrame, key: str, order: list[str], text: str = "value", most: int = PIECE_CHARS, *,
    write: Callable[[DataFrame], DataFrame] | None = None, tasks: int | None = None,
) -> DataFrame:
    """(``key``, ``piece``, ``text``): the texts of each ``key`` in ``order``, cut so that no row holds more than ``most`` characters.

    ``piece`` numbers a key's rows from 1 without a gap; put together in that order, with a line break after each text but
    not within one (``last`` is true where a text ends), they are the whole. Rows are numbered over the whole table by
    ranges, so a key with a third of all rows is no task of its own, and each key's first number is looked up. Texts that
    ``write`` makes of the rows are made once, in the ranges, and not to find them.
    """

    def cut(dealt: DataFrame) -> DataFrame:
        texts = write(dealt) if write else dealt
        cuts = F.sequence(F.lit(0), F.floor((F.greatest(F.char_length(text), F.lit(1)) - 1) / most).cast("int"))
        parts = texts.select(key, *order, text, F.explode(cuts).alias("_cut"), F.size(cuts).alias("_cuts"))
        part = F.substring(F.col(text), F.col("_cut") * most + 1, F.lit(most))
        return parts.select(key, *order, "_cut", part.alias(text), (F.col("_cut") == F.col("_cuts") - 1).alias("last"))

    numbered = number_rows(lines, [key, *order], "_line", make=cut, within=["_cut"], tasks=tasks)
    firsts = numbered.groupBy(key).agg((F.min("_line") - 1).alias("_before"))
    return skewed_lookup(numbered, firsts, key).select(key, (F.col("_line") - F.col("_before")).alias("piece"), text, "last")


def step_summary_pieces(step_rows: DataFrame, key: str = "name", most: int = PIECE_CHARS, tasks: int | None = None) -> DataFrame:
    """The records of :func:`step_report_lines` in rows of bounded length: (file_name, piece, value, last)."""
    rows = _report_rows(step_rows, key, tasks)
    return bounded_pieces(rows, "file_name", ["path", "step_ord"], "value", most, write=_report_lines, tasks=tasks)
