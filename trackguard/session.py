"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIR: dict[str, str] = {}


def local_session(cores: int | str = "*", name: str = "trackguard", memory: str = "12g") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    spark = (SparkSession.builder.master(f"local[{cores}]").appName(name)
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.driver.memory", memory)
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach. The cluster names it in spark.checkpoint.dir, and its word is
    taken (a file: address may be a mounted share); only a local session without that setting gets a folder
    of its own, which goes with the process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIR:
        _LOCAL_DIR[app] = tempfile.mkdtemp(prefix="trackguard-")
        atexit.register(shutil.rmtree, _LOCAL_DIR[app], ignore_errors=True)
    return _LOCAL_DIR[app]


def app_dir(spark: SparkSession) -> str:
    """Where this application's intermediate tables lie."""
    return f"{shared_dir(spark).rstrip('/')}/trackguard/{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Removes this application's intermediate tables. Call it at the end, when no result that reads them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(app_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and reads them back. Later rounds start from that
    table, so lineage stays short, a lost executor costs nothing that is already written, and
    the planner knows the real size."""
    spark = df.sparkSession
    path = f"{app_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, limit_bytes: int = 32 << 20) -> bool:
    """True when the optimizer's own size estimate is below the limit: the check before a broadcast."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit_bytes
