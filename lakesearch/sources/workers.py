"""Making this package importable in Python workers, wherever the driver found it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    package = Path(__file__).resolve().parent.parent
    # the driver's own file server hands it out; executors never read this path
    target = os.path.join(tempfile.mkdtemp(prefix="lakesearch-code-"), "lakesearch_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, str(file.relative_to(package.parent)))
    spark.sparkContext.addPyFile(target)


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores for work in Python, where its input is so small that a scan gives fewer partitions than there are
    cores. A scan gives a partition to every few MB (spark.sql.files.openCostInBytes) until all cores are busy, so the sizes
    of the plan's inputs tell, and no job is run to find out. A table of any size stays as it is, without a shuffle."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    least = int(spark._jsparkSession.sessionState().conf().filesOpenCostInBytes())
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return df.repartition(cores) if size < cores * least else df
