"""Python tasks on executors: the package travels with the application, so executors need no copy of it."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, GroupedData, SparkSession

_shipped: set[str] = set()

#: Rows of an Arrow batch that holds whole texts.
TEXT_ROWS = 1_000
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def short_batches(spark: SparkSession) -> None:
    """From now on rows go to Python by ``TEXT_ROWS`` at most: with Spark's 10,000 one batch of whole texts fills tens of MB,
    in the executor's buffers and again in the worker. A smaller setting is kept."""
    if not 0 < int(spark.conf.get(BATCH_ROWS)) <= TEXT_ROWS:
        spark.conf.set(BATCH_ROWS, str(TEXT_ROWS))


def ship(spark: SparkSession) -> None:
    """Hand the package's sources to every executor, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="spark-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def map_arrow(df: DataFrame, fn: Callable, schema) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def group_arrow(grouped: GroupedData, fn: Callable, schema) -> DataFrame:
    ship(grouped._df.sparkSession)
    return grouped.applyInArrow(fn, schema)
