"""Written tables that cut lineage between the rounds of an iterative operator.

They live in the shared folder that the cluster names in ``spark.checkpoint.dir``; only on a
local master, where that is unset, a folder of our own is made and set. A table written there
survives the loss of any executor, and its size is known to the planner.

While a table is written, Spark is told to delete the shuffle files of that write as soon as
it ends: nothing else reads them. Tables are deleted by ``drop`` when an operator no longer
reads them, the rest by ``close`` (``close_all``), at the latest when the driver ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OPEN: dict[str, Stage] = {}


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the cluster; on a local master one of our own where none is configured."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    at = sc._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="kinspark-")
    atexit.register(shutil.rmtree, own, True)
    sc.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


@contextmanager
def _cleaning(spark: SparkSession):
    """Shuffle files of the queries inside go as soon as each ends (where this Spark knows the setting)."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


class Stage:
    """Tables of one run of an operator: ``put`` writes and reads back, ``drop`` deletes what is no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/kinspark-{uuid.uuid4().hex}"
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()  # they outlive the session
        _OPEN[self.root] = self

    def put(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        schema = df.schema
        with _cleaning(self.spark):
            df.write.parquet(path, compression=compression)
        back = self.spark.read.schema(schema).parquet(path)
        back._kinspark_path = path
        return back

    def _delete(self, path: str) -> None:
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.conf).delete(p, True)

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            path = getattr(df, "_kinspark_path", None)
            if path:
                self._delete(path)

    def close(self) -> None:
        """Deletes all tables; results that read them can't be read any more."""
        if _OPEN.pop(self.root, None):
            self._delete(self.root)


def close_all() -> None:
    """Closes every stage of this driver, for callers that have consumed their results."""
    for stage in list(_OPEN.values()):
        try:
            stage.close()
        except Exception:  # the session may be gone already
            _OPEN.pop(stage.root, None)


atexit.register(close_all)
