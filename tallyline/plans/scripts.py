"""Jobs over a corpus of scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions.text import base_output_name, csv_field, output_name
from tallyline.operators import block_reports, blocks, check_sql, lineage_reports, line_stats
from tallyline.operators.lineage import extract_stats, extract_tables
from tallyline.operators.steps import step_rows
from tallyline.session import materialize
from tallyline.sinks.csv_files import headed_lines, write_report
from tallyline.sinks.file_tree import write_files, write_tree
from tallyline.sources.pk_list import read_pk_list
from tallyline.sources.scripts import ANY, SQL_ANY_CASE, SQL_OR_BQ, accepted, read_scripts, rejected, scan_scripts

# Report headers.
SUMMARY_HEADERS = ["File Name", "Source Tables", "Target Tables"]
STEP_HEADERS = ["File Name", "Source Tables", "Target Tables", "Steps", "Total Steps"]
SOURCE_MAP_HEADERS = ["Program", "Source Table", "Target Tables"]
TARGET_MAP_HEADERS = ["Program", "Target Table", "Source Tables"]
BLOCK_HEADERS = ["Step", "Table", "Column", "Condition", "Alias->Original", "Error"]


def _report(df: DataFrame, path: str, headers: list[str], order_by: list[Column]) -> None:
    write_report(df, path, headers=headers, order_by=order_by, bom=True)


def lineage_job(spark: SparkSession, source: str, target: str, *, charset: str = "UTF-8", key: str = "name") -> None:
    """Tables of every script: a text per script, a summary and the two table maps."""
    found = materialize(extract_tables(read_scripts(spark, source, charset=charset)), "lineage")
    texts = lineage_reports.file_text(found)
    write_files(texts, target, output_name(F.col("path"), "_sql_tables.txt"), F.col("content"))
    _report(lineage_reports.file_summary(found, key), f"{target}/summary.csv", SUMMARY_HEADERS, [F.col("file_name")])
    _report(
        lineage_reports.source_map(found, key), f"{target}/source_table_mapping.csv", SOURCE_MAP_HEADERS,
        [F.col("source_table"), F.col("program")],
    )
    _report(
        lineage_reports.target_map(found, key), f"{target}/target_table_mapping.csv", TARGET_MAP_HEADERS,
        [F.col("target_table"), F.col("program")],
    )


def step_job(spark: SparkSession, source: str, target: str, *, charset: str = "UTF-8", key: str = "name") -> None:
    """Tables of every step: a text per script and a summary."""
    rows = materialize(step_rows(read_scripts(spark, source, charset=charset)), "steps")
    files = lineage_reports.step_files(rows)
    write_files(files, target, output_name(F.col("path"), "_step_tables.txt"), F.col("content"))
    pieces = lineage_reports.step_report_lines(rows, key)
    order = [F.col("file_name"), F.col("path"), F.col("step_ord")]
    headed_lines(pieces, F.col("value"), STEP_HEADERS, order, bom=True).write.text(f"{target}/step_summary.csv")


def check_job(
    spark: SparkSession, source: str, target: str, *, pk_list: str | None = None,
    base_date: str = check_sql.DEFAULT_BASE_DATE, charset: str = "UTF-8", whole: bool = False,
) -> tuple[int, int]:
    """Check statements for the tables of every script, one file per dialect; with ``whole`` the target holds nothing else then."""
    found = extract_tables(read_scripts(spark, source, charset=charset))
    keys = read_pk_list(spark, pk_list, charset=charset) if pk_list else None
    # Stored, as a writer looks at the paths before it writes the texts.
    files = materialize(check_sql.check_file_rows(check_sql.check_files(found, keys, base_date)), "check-files")
    return (write_tree if whole else write_files)(files, target, F.col("path"), F.col("content"))


def scan_job(
    spark: SparkSession, source: str, target: str, *, rules: str = "scan", charset: str = "MS949", whole: bool = False
) -> tuple[int, int]:
    """Numbered targets and sources of every script; ``rules`` is ``scan`` or ``simple``, ``whole`` as in :func:`check_job`."""
    found = extract_tables(read_scripts(spark, source, glob=SQL_ANY_CASE, charset=charset), rules)
    labels = ("[Target]", "[Source]") if rules == "simple" else ("[Target Tables]", "[Source Tables]")
    texts = lineage_reports.numbered_text(found, root=source.rstrip("/") + "/", labels=labels)
    return (write_tree if whole else write_files)(texts, target, base_output_name(F.col("path"), ".source_target.txt"), F.col("content"))


def line_count_job(spark: SparkSession, source: str, *, charset: str = "UTF-8", max_bytes: int | None = None) -> dict[str, DataFrame]:
    """Statistics per file, the same as shown, files per extension, all sources, and the files left out.

    ``files`` holds whole names, targets and sources, ``shown`` the values cut for display. Files above ``max_bytes``,
    if given, are listed in ``skipped`` with those that cannot be read.
    """
    scanned = scan_scripts(spark, source, glob=ANY, charset=charset, max_bytes=max_bytes)
    stats = materialize(line_stats.file_line_stats(accepted(scanned)), "lines")
    return {
        "files": stats,
        "shown": line_stats.display_stats(stats),
        "extensions": line_stats.extension_counts(stats),
        "sources": lineage_reports.distinct_sources(stats),
        "skipped": rejected(scanned),
    }


def statistics_job(spark: SparkSession, source: str, *, charset: str = "UTF-8") -> dict[str, DataFrame]:
    """Tables and ``SELECT *`` of every ``.sql`` and ``.bq`` script, and the files left out."""
    scanned = scan_scripts(spark, source, glob=SQL_OR_BQ, charset=charset)
    return {"files": extract_stats(accepted(scanned)), "skipped": rejected(scanned)}


def block_job(
    spark: SparkSession, source: str, target: str, *, version: int = 4, csv: bool = True, html: bool = True,
    charset: str = "UTF-8",
) -> dict[str, DataFrame]:
    """Facts of every nested block as CSV and HTML; returns the totals and duplicate statistics.

    A page keeps the whole name of its script (``job.sql.html``), so ``job.sql`` and ``job.bq`` have a page each.
    """
    scripts = read_scripts(spark, source, glob=ANY, charset=charset)
    facts = materialize(blocks.block_facts(blocks.split_nested_blocks(scripts), version), "blocks")
    if csv:
        errors = version >= 3
        rows = block_reports.ragged_report(facts, errors=errors)
        shown = rows.drop("path", "block_ord", "line")
        write_report(
            rows, f"{target}/output.csv", headers=BLOCK_HEADERS[: len(shown.columns)],
            fields=[csv_field(F.col(f"`{c}`")) for c in shown.columns], order_by=[F.col("path"), F.col("block_ord"), F.col("line")],
        )
    if html and version >= 3:
        pages = block_reports.html_report(facts, version)
        write_files(pages, target, F.concat(F.col("path"), F.lit(".html")), F.col("content"))
    return {
        "totals": block_reports.block_totals(facts),
        "duplicate_tables": block_reports.block_duplicates(facts, "tables"),
        "duplicate_columns": block_reports.block_duplicates(facts, "columns"),
    }
