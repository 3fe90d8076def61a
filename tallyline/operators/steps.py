"""Scripts cut at their STEP marker comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.arrays import keep_last_values, posexplode_items
from tallyline.functions.text import trim_blanks
from tallyline.operators.lineage import extract_tables
from tallyline.operators.rules import RuleSet

# Fixed value: the comment that opens a step.
STEP_MARKER = r"(?i)(?:/\*\s*STEP(\d+)\s*\*/|--\s*STEP(\d+))"


def step_bodies(raw: Column) -> Column:
    """(name, value) of every non-empty step; text before the first marker is left out."""
    markers = F.regexp_extract_all(raw, F.lit(STEP_MARKER), F.lit(0))
    bodies = F.split(raw, STEP_MARKER, -1)
    pairs = F.zip_with(
        markers,
        F.slice(bodies, 2, F.size(bodies)),
        lambda marker, body: F.struct(
            F.concat(F.lit("STEP"), F.regexp_extract(marker, r"(\d+)", 1)).alias("name"),
            trim_blanks(body).alias("value"),
        ),
    )
    return F.filter(pairs, lambda pair: pair["value"] != "")


def count_steps(scripts: DataFrame, text: str = "raw") -> DataFrame:
    """Number of non-empty steps per script, repeated names counted each time."""
    keep = [c for c in scripts.columns if c != text]
    return scripts.select(*keep, F.size(step_bodies(F.col(text))).alias("steps"))


def split_steps(scripts: DataFrame, text: str = "raw") -> DataFrame:
    """One row per script and step name: ``step_ord`` from 1, ``step``, ``body``.

    A repeated name keeps its first place and its last body.
    """
    keep = [c for c in scripts.columns if c != text]
    pairs = scripts.select(*keep, step_bodies(F.col(text)).alias("_steps"))
    rows = posexplode_items(keep_last_values(pairs, "_steps"), "_steps", "_pos", "_step")
    return rows.select(
        *keep, (F.col("_pos") + 1).alias("step_ord"), F.col("_step.name").alias("step"), F.col("_step.value").alias("body")
    )


def step_tables(scripts: DataFrame, rules: RuleSet | str = "std", text: str = "raw") -> DataFrame:
    """Sources and targets of every step."""
    return extract_tables(split_steps(scripts, text), rules, "body")


def step_rows(scripts: DataFrame, rules: RuleSet | str = "std", text: str = "raw") -> DataFrame:
    """Like :func:`step_tables`, with one row without a step for each script that has none.

    ``step_ord`` counts from 0 and is null for that row.
    """
    keep = [c for c in scripts.columns if c != text]
    pairs = keep_last_values(scripts.select(*keep, step_bodies(F.col(text)).alias("_steps")), "_steps")
    rows = pairs.select(*keep, F.posexplode_outer("_steps").alias("step_ord", "_step")).select(
        *keep, "step_ord", F.col("_step.name").alias("step"), F.coalesce(F.col("_step.value"), F.lit("")).alias("body")
    )
    return extract_tables(rows, rules, "body")


def tables_of_step(scripts: DataFrame, step: str, rules: RuleSet | str = "std", text: str = "raw") -> DataFrame:
    """Sources and targets of the step with this name; other steps are dropped before they are read."""
    return extract_tables(split_steps(scripts, text).where(F.col("step") == step), rules, "body")


def step_counts(tables: DataFrame) -> DataFrame:
    """Number of sources and targets per step."""
    keep = [c for c in tables.columns if c not in ("sources", "targets")]
    return tables.select(*keep, F.size("sources").alias("n_sources"), F.size("targets").alias("n_targets"))
