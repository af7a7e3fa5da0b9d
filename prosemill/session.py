"""Makes the package importable on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Sends the package's modules to the executors, once for each Spark application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="prosemill-"), "prosemill_modules.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(top.rglob("*")):
            if path.is_file() and path.suffix in (".py", ".toml"):
                out.write(path, path.relative_to(top.parent))
    spark.sparkContext.addPyFile(archive)
    _shipped[app] = archive


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, run with the package's modules on the executors."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
