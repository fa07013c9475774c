"""Session helpers shared by every part of the library."""

from __future__ import annotations

import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession


def build(app: str = "presslake", master: str = "local[*]", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, so that workers can import it anywhere."""
    context = spark.sparkContext
    if getattr(context, "_presslake_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="presslake-")) / "presslake_code.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, f"presslake/{path.relative_to(root)}")
    context.addPyFile(str(target))
    context._presslake_shipped = True


def by_value(name: str) -> None:
    """Send what a module of this package defines along with what uses it: a stream's processor is also set up where the shipped package isn't."""
    register_pickle_by_value(sys.modules[name])


def shared_folder(spark: SparkSession) -> str:
    """The folder of this session under the one that the cluster names in spark.checkpoint.dir.

    Without that setting only a local session has a folder of its own; on a cluster it would be a disk
    that the other machines don't see.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: columns that a reader leaves out cost it nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files of a DataFrame that checkpoint() gave and that nothing reads any more."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
