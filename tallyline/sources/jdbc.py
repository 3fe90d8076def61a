"""Settings of a database script run and the matching Spark source."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# The environment names the settings are read from, and the default file name.
ENV_NAMES = {
    "url": "APP_SQL_JDBC_URL",
    "user": "APP_SQL_USERNAME",
    "password": "APP_SQL_PASSWORD",
    "script_path": "APP_SQL_SCRIPT_PATH",
    "output_dir": "APP_SQL_OUTPUT_DIR",
    "output_name": "APP_SQL_EXCEL_NAME",
}
DEFAULT_OUTPUT_NAME = "result.xlsx"


@dataclass(frozen=True)
class ScriptRunSettings:
    """Where a script runs and where its result goes."""

    url: str = ""
    user: str = ""
    password: str = ""
    script_path: str = ""
    output_dir: str = ""
    output_name: str = DEFAULT_OUTPUT_NAME

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> ScriptRunSettings:
        source = os.environ if env is None else env
        return cls(**{field: source[name] for field, name in ENV_NAMES.items() if name in source})

    def output_path(self) -> str:
        return os.path.join(self.output_dir, self.output_name.strip() and self.output_name or DEFAULT_OUTPUT_NAME)

    def validate(self, *, needs_database: bool = True) -> None:
        """Raise ``ValueError`` for the first missing setting."""
        required = [("script_path", "SQL script path"), ("output_dir", "output directory")]
        if needs_database:
            required = [("url", "JDBC URL"), ("user", "database user"), *required]
        for field, label in required:
            if not getattr(self, field).strip():
                raise ValueError(f"{label} is required")


def jdbc_options(settings: ScriptRunSettings, query: str, **partitioning: str) -> dict[str, str]:
    """Options of Spark's ``jdbc`` source for one query.

    Pass ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions``
    to read a large result in parallel; those need a table expression, so the
    query is then given as one.
    """
    options = {"url": settings.url, "user": settings.user, "password": settings.password}
    if partitioning:
        return {**options, "dbtable": f"({query}) q", **partitioning}
    return {**options, "query": query}


def read_jdbc(spark: SparkSession, settings: ScriptRunSettings, query: str, **partitioning: str) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(settings, query, **partitioning)).load()
