"""Session settings that the library relies on, and shipping of its code to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows of text can be long: small Arrow batches keep Python workers small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}

_SHIPPED = "_lodestream_shipped"


def tune(spark: SparkSession) -> SparkSession:
    """Apply SETTINGS and make the package importable on executors (once per context)."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    sc = spark.sparkContext
    if not getattr(sc, _SHIPPED, False):
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="lodestream-")) / "lodestream.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for path in sorted(root.rglob("*.py")):
                z.write(path, path.relative_to(root.parent))
        sc.addPyFile(str(archive))
        setattr(sc, _SHIPPED, True)
    return spark


def local_session(app: str = "lodestream", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks."""
    return tune(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", os.environ.get("LODESTREAM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; on a local master (tests) one of our own where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_lodestream_dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="lodestream-shared-")
        spark.sparkContext._lodestream_dir = path
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def _settled(spark: SparkSession) -> list[str]:
    """Paths of the tables that this context has settled and not dropped."""
    if not hasattr(spark.sparkContext, "_lodestream_tables"):
        spark.sparkContext._lodestream_tables = []
    return spark.sparkContext._lodestream_tables


def settle(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write df to a table in the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    _settled(spark).append(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at the path, on whatever file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def mark(spark: SparkSession) -> int:
    """A point for drop_since."""
    return len(_settled(spark))


def drop_since(spark: SparkSession, point: int, keep: int = 0) -> None:
    """Remove the tables settled since the point, but for the last `keep`: nothing may read them any more."""
    paths = _settled(spark)
    gone = paths[point : len(paths) - keep]
    fs = spark._jvm.org.apache.hadoop.fs
    for path in gone:
        at = fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    paths[point : len(paths) - keep] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
