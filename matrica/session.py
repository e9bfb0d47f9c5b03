"""Session and lineage helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "matrica", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the library expects (UTC, AQE)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared spark.checkpoint.dir; a private folder only where one JVM runs everything."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", "") or sc.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        folder = sc.getCheckpointDir()
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and go on from it; survives lost executors.

    A written table, and not checkpoint(), as a checkpoint hands the constraints of its plan on, which grow without
    bound over the rounds of an iteration, and as a table's size is known to the planner. It goes by release(), or
    when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    table = spark.read.schema(df.schema).parquet(path)
    table._matrica_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables of cut_lineage whose every reader has been written in turn, so that rounds do not pile up."""
    for table in tables:
        path = getattr(table, "_matrica_path", None)
        if path:
            place = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_matrica_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / "matrica.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, Path(root.name) / path.relative_to(root))
    sc.addPyFile(str(target))
    sc._matrica_shipped = True
