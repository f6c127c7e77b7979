"""Session helpers: a local session for tests and lineage cuts that survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def local_session(cores: int = 4, **conf: str) -> SparkSession:
    """A session for tests and benches on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("claimloom")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    # Python workers find the package where the driver does
    session.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parent.parent))
    return session


def work_folder(spark: SparkSession) -> str:
    """This application's folder in the shared folder of spark.checkpoint.dir; it is deleted when the application ends.

    Only a local session may leave the setting out, as tests do; it gets a temporary folder. On a cluster such a folder
    would be one machine's own, so that is refused.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _FOLDERS:
        shared = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
        if shared is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="claimloom-")
        folder = f"{shared.rstrip('/')}/claimloom-{sc.applicationId}"
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
        _FOLDERS[sc.applicationId] = folder
    return _FOLDERS[sc.applicationId]


def scratch(spark: SparkSession) -> str:
    """A path of its own in the work folder."""
    return f"{work_folder(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` once as a table of the shared work folder; later plans read it from there.

    No executor holds anything of it, so the loss of one costs nothing. Later plans read only the columns they need, know
    its size (for broadcasts within Spark's limit), and can split its hot keys in joins, as both sides are then shuffled.
    """
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def release(*frames: DataFrame | None) -> None:
    """Deletes the tables of cuts that no plan will read again; anything else is left alone."""
    for df in frames:
        if df is not None and (folder := _PATHS.pop(df, None)):
            sc = df.sparkSession.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
