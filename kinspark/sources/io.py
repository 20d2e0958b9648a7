"""Sources and sinks: files in, files out, with the null spellings and quoting that free text needs."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import to_number

#: Spellings of a missing value in CSV files (fixed values).
CSV_NULLS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

SPLITS, MODELS, STRATEGIES = ("train", "val", "test"), ("logistic", "distance", "text"), ("B1", "B2")


def require(spark: SparkSession, path: str) -> str:
    """``path``, or FileNotFoundError with it in the message; any file system that Spark knows."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(f"not found: {path}")
    return path


def read_csv(
    spark: SparkSession, path: str, schema: StructType | str | None = None, columns: list[str] | None = None, nulls: list[str] | None = None, recursive: bool = False,
    multi_line: bool = False, infer: bool = False, doubles: list[str] | None = None,
) -> DataFrame:
    """A CSV file or folder with header; doubled quotes are kept.

    Without ``schema`` all columns are text, or what ``infer`` (one more pass over the file)
    takes them for; those of ``doubles`` that exist become numbers, null where they are
    none. Spellings of nothing in text columns become null. ``columns`` keeps those of them
    that exist. ``multi_line`` is for values with quoted line ends: every file is then one
    task, so read such files once and write them as a table.
    """
    r = spark.read.option("header", True).option("multiLine", multi_line).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").option("inferSchema", infer)
    if recursive:
        r = r.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
    if schema is not None:
        r = r.schema(schema)
    df = r.csv(require(spark, path))
    tokens = CSV_NULLS if nulls is None else nulls
    df = df.withColumns({c: F.when(~F.col(f"`{c}`").isin(tokens), F.col(f"`{c}`")) for c, t in df.dtypes if t == "string"})
    df = df.withColumns({c: to_number(F.col(f"`{c}`")) for c in doubles or [] if c in df.columns})
    return df if columns is None else df.select(*[c for c in columns if c in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(require(spark, path))
    return df if columns is None else df.select(*[c for c in columns if c in df.columns])


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_lines(df: DataFrame, path: str, column: str = "value") -> None:
    """One text column, one line per row."""
    df.select(column).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(require(spark, path))


def _file(path: str):
    """Hadoop's path and file system of ``path``: the pipeline's files may lie on any that Spark knows."""
    sc = SparkSession.active().sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(sc._jsc.hadoopConfiguration())


def write_json(value: dict | list, path: str) -> None:
    """A small object of the driver's."""
    p, fs = _file(path)
    out = fs.create(p, True)
    out.write(json.dumps(value, indent=4, default=str).encode("utf-8"))
    out.close()


def load_json(path: str) -> dict | list:
    p, fs = _file(path)
    if not fs.exists(p):
        raise FileNotFoundError(f"not found: {path}")
    return json.loads(SparkSession.active().read.text(path, wholetext=True).first()[0])


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str) -> PipelineModel:
    return PipelineModel.load(require(spark, path))


def show(df: DataFrame, columns: list[str] | None = None, rows: int = 50) -> None:
    df.select(*(columns or df.columns)).show(rows, truncate=False)


@dataclass(frozen=True)
class Catalog:
    """Where the pipeline's tables, models and reports lie."""

    root: str

    def _of(self, kind: str, name: str, known: tuple[str, ...]) -> None:
        if name not in known:
            raise ValueError(f"unknown {kind} {name!r}; known are {list(known)}")

    @property
    def mediated(self) -> str:
        return f"{self.root}/mediated"

    @property
    def cleaned(self) -> str:
        return f"{self.root}/cleaned"

    @property
    def truth(self) -> str:
        return f"{self.root}/ground_truth"

    def split(self, name: str) -> str:
        self._of("split", name, SPLITS)
        return f"{self.truth}/{name}"

    def candidates(self, strategy: str) -> str:
        self._of("strategy", strategy, STRATEGIES)
        return f"{self.root}/blocking/{strategy}/candidates"

    def stats(self, strategy: str) -> str:
        self._of("strategy", strategy, STRATEGIES)
        return f"{self.root}/blocking/{strategy}/stats.json"

    def lines(self, name: str) -> str:
        self._of("text set", name, (*SPLITS, *STRATEGIES))
        return f"{self.root}/lines/{name}"

    def model(self, name: str) -> str:
        self._of("model", name, MODELS)
        return f"{self.root}/models/{name}"

    def meta(self, name: str) -> str:
        self._of("model", name, MODELS)
        return f"{self.root}/models/{name}.json"

    @property
    def evaluation(self) -> str:
        return f"{self.root}/evaluation.json"

    @property
    def report(self) -> str:
        return f"{self.root}/report.json"

    def ensure(self) -> None:
        for d in ("blocking", "lines", "models"):
            p, fs = _file(f"{self.root}/{d}")
            fs.mkdirs(p)
