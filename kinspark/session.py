"""Session settings: only what the plans rely on; sizes stay with the cluster's own configuration."""

from __future__ import annotations

import functools
import io
import os
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(app: str = "kinspark", master: str | None = None, **extra: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller passes its own."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = DEFAULTS | {
        "spark.driver.memory": "8g",
        "spark.sql.shuffle.partitions": cpus,
    } | {k.replace("__", "."): v for k, v in extra.items()}
    b = SparkSession.builder.appName(app).master(master or f"local[{cpus}]")
    for k, v in conf.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


_SHIPPED: set[str] = set()


def _send(spark: SparkSession) -> None:
    """Give this package to the session's Python workers, once per application, by the shared folder."""
    from .operators.stage import shared_dir

    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here, packed = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, str(f.relative_to(here.parent)))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{here.name}-{app}.zip")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    out.write(packed.getvalue())
    out.close()
    spark.sparkContext.addPyFile(path.toString())
    _SHIPPED.add(app)


def ship(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``query``, with the package sent to the workers first: they need no installed copy of it."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _send(spark)
        return query(spark, sf_dir)

    return run
