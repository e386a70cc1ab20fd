"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(app: str = "frameloom", cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings every operator assumes (AQE on, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor, once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_frameloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent).as_posix())
    target = f"{fresh_folder(spark, 'package')}/frameloom.zip"
    path = sc._jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    out.write(packed.getvalue())
    out.close()
    sc.addPyFile(target)
    sc._frameloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only on local masters."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    held = sc.getCheckpointDir()
    if held:
        return held
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="frameloom-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(made)
    return sc.getCheckpointDir()


def fresh_folder(spark: SparkSession, stem: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex}"


def make_folder(spark: SparkSession, path: str) -> str:
    """The path of a folder that is there from now on, with what it may hold already."""
    sc = spark.sparkContext
    held = sc._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(sc._jsc.hadoopConfiguration()).mkdirs(held)
    return path


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that :func:`fresh_folder` named, with all that was written there."""
    sc = spark.sparkContext
    held = sc._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(sc._jsc.hadoopConfiguration()).delete(held, True)
