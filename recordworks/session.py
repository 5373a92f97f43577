"""Session settings the jobs rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

# UTC keeps timestamps comparable; AQE re-plans joins and splits skewed partitions at run time; a filter inferred from an explode computes the
# exploded array, here often a whole page's parse, a second time
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.optimizer.excludedRules": "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def tuned(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session that somebody else built."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName("recordworks")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", memory)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the cluster names in `spark.checkpoint.dir`.  A local temporary folder serves only where
    none is configured and the session is local (tests, benchmark)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/recordworks-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The files of a table; no rows while nothing has been written there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class Scratch:
    """Tables between the steps of one job.  Each is written once to the shared folder and read back: nothing is computed twice, a
    lost executor costs no recomputation, and plans stay short.  `drop` gives the disk back once the next step is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, shared_folder(spark)
        self._paths: dict[int, tuple[DataFrame, str]] = {}
        self._written = 0

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self._written}"
        self._written += 1
        df.write.option("compression", "zstd").parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(table)] = (table, path)
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Empties tables of this folder; frames built on them can't be computed any more."""
        for table in tables:
            _, path = self._paths.pop(id(table))
            self.spark.range(0, 0, 1, 1).write.mode("overwrite").parquet(path)  # works on any file system and through Spark Connect

    def step(self, df: DataFrame, *used: DataFrame) -> DataFrame:
        """`df` kept, then what it was made from dropped."""
        table = self.keep(df)
        self.drop(*used)
        return table


def settled(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder and read back, for tables that live as long as the result."""
    return Scratch(df.sparkSession).keep(df)
