"""Session defaults, shipping of the package to executors, and lineage cuts on shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: dict[str, str] = {}


def get_session(app: str = "quire", master: str | None = None, **conf) -> SparkSession:
    """A local session with the defaults the operators are tested under; a cluster's own settings win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.host": "127.0.0.1",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make this package importable on every executor (once per application)."""
    sc = spark.sparkContext
    if _SHIPPED.get("app") == sc.applicationId:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="quire-ship-"), "quire_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(path)
    _SHIPPED["app"] = sc.applicationId


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's spark.checkpoint.dir; a local one only where it is unset and the
    master is local, since executors on other machines would not see each other's files there."""
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="quire-shared-")
        sc.setCheckpointDir(d)
    return d.rstrip("/")


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Cut lineage by writing a table in the shared folder and reading it back (columnar, prunable)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of materialized tables that nothing still to be run reads; other DataFrames are left alone."""
    for t in tables:
        path = getattr(t, "_table", None)
        if path:
            spark = t.sparkSession
            hp = spark._jvm.org.apache.hadoop.fs.Path(path)
            hp.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hp, True)
            t._table = None


def small_rows(df: DataFrame, most: int) -> list:
    """The rows of a table that is small by its nature; more than `most` of them are an error, never cut off."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table of at most {most} rows is expected, this one has more")
    return rows


def arrow_rows(spark: SparkSession, n: int) -> None:
    """Bound the rows of one Arrow batch, so that long texts do not fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(n))
