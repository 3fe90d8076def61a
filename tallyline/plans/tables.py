"""Jobs over tables: reconcile two files, pivot a job list, run a script."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallyline.functions.text import csv_field
from tallyline.operators.compare import compare
from tallyline.operators.pivot import FIRST_SEEN, job_report_fields, pivot_jobs
from tallyline.operators.statements import run_script
from tallyline.session import materialize
from tallyline.sinks.csv_files import CRLF, write_csv, write_report
from tallyline.sources.csv_files import ROW_ORDER, read_csv, read_eav
from tallyline.sources.jdbc import ScriptRunSettings
from tallyline.sources.scripts import ANY, read_scripts


def parse_keys(keys: str | Sequence[str] | None) -> list[str] | None:
    """``"ID, DATE"`` as a list; None or blank for the default key."""
    if keys is None:
        return None
    parts = keys.split(",") if isinstance(keys, str) else keys
    return [k.strip() for k in parts if k.strip()] or None


def result_path(path: str) -> str:
    """``result_<name>`` beside the file."""
    folder, slash, name = path.rpartition("/")
    return f"{folder}{slash}result_{name}"


def reconcile_files(
    spark: SparkSession,
    file1: str,
    file2: str,
    keys: str | Sequence[str] | None = None,
    *,
    out: str | None = None,
    multi_line: bool = False,
    ordered: bool = True,
) -> str:
    """Compare two CSV tables and write the result; returns where it was written.

    The output is a folder whose parts, joined in name order, are the one CRLF
    file: rows of file 1 in their order, then the keys only file 2 has. Without
    ``ordered`` the rows are written as the join leaves them, each part with a
    header, which saves the sort. Files are read in parallel; those with line
    breaks inside quotes need ``multi_line``, at one task per file.
    """
    df1 = read_csv(spark, file1, multi_line=multi_line, row_order=ordered)
    df2 = read_csv(spark, file2, multi_line=multi_line, row_order=ordered)
    result = compare(df1, df2, parse_keys(keys))
    target = out or result_path(file1)
    if not ordered:
        write_csv(result, target)
        return target
    shown = [c for c in result.columns if c != ROW_ORDER]
    fields = [csv_field(F.col(f"`{c}`")) for c in shown]
    write_report(result, target, headers=shown, fields=fields, order_by=[F.col(ROW_ORDER)], line_sep=CRLF)
    return target


def pivot_job_list(spark: SparkSession, source: str, target: str) -> None:
    """Key/value job list to the wide job report, groups in the order they first appear.

    Nothing is written for a list without rows.
    """
    wide = materialize(pivot_jobs(read_eav(spark, source), first_seen=True), "pivot")
    if wide.isEmpty():
        return
    headers = [c for c in wide.columns if c != FIRST_SEEN]
    write_report(wide, target, headers=headers, fields=job_report_fields(wide), order_by=[F.col(FIRST_SEEN)], bom=True)


def run_script_job(spark: SparkSession, settings: ScriptRunSettings) -> str:
    """Run the script on Spark tables and write its rows as CSV; returns where they went."""
    settings.validate(needs_database=False)
    script = read_scripts(spark, settings.script_path, glob=ANY, strict=True).select("raw").first()
    if script is None:
        raise ValueError(f"script not found or unreadable: {settings.script_path}")
    write_report(run_script(spark, script["raw"]), settings.output_path())
    return settings.output_path()
