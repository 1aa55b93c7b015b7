"""Tables in and out."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType


def read_table(spark: SparkSession, path: str, kind: str = "parquet", schema: StructType | str | None = None) -> DataFrame:
    """A parquet, csv or json table; NaN in floating columns becomes NULL.  CSV needs a schema: nothing is inferred by a scan."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind == "csv":
        if schema is None:
            raise ValueError("a csv table needs a schema")
        reader = reader.option("header", True)
    df = reader.format(kind).load(path)
    floats = {f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))}
    return df.select(*(F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns))


def write_csv(df: DataFrame, path: str) -> None:
    """Result tables with a header line in each part."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """One CSV folder for each table of a report."""
    for name, df in tables.items():
        write_csv(df, f"{path}/{name}")


_own: list[str] = []


def kept(df: DataFrame) -> DataFrame:
    """df written to the folder that the session names in spark.checkpoint.dir and read again: its lineage ends there.

    Where none is named an own folder serves, under a local master only.  What was written goes when the driver ends.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder (see kept); what is written there goes when the driver ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or (_own and _own[0])
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _own.append(folder := tempfile.mkdtemp(prefix="strandline-"))
    path = f"{folder}/strandline/{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
