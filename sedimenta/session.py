"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

from sedimenta.errors import UserError


def local_session(cores: str = "*", app: str = "sedimenta", **conf: str) -> SparkSession:
    """A session for tests and single machines; on a cluster the caller brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset and the session runs on
    one machine (tests) a temporary folder is taken, set for the session and removed at its end.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        if not sc.master.startswith("local"):
            raise UserError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="sedimenta-")
        atexit.register(shutil.rmtree, own, True)
        at = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", at)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


#: Tables written by this process, for ``release``.
_written: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(at)
    return at


def release(spark: SparkSession) -> int:
    """Remove the tables that ``materialise`` wrote so far; nothing that reads them may be used afterwards."""
    conf, path = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    n = len(_written)
    while _written:
        at = path(_written.pop())
        at.getFileSystem(conf).delete(at, True)
    return n


def _release_at_exit() -> None:
    """Tables that nobody can read any more go with the process, as long as its session still answers."""
    spark = SparkSession.getActiveSession() if _written else None
    if spark is not None:
        try:
            release(spark)
        except Exception:
            pass  # the session is gone: the folder's owner removes what is left


atexit.register(_release_at_exit)


def materialise(df, name: str):
    """Write ``df`` below the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    at = scratch(spark, name)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once per context: they may not see the folder that the driver imports it from."""
    sc = spark.sparkContext
    if getattr(sc, "_sedimenta_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="sedimenta-ship-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/sedimenta.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for at, folders, names in os.walk(os.path.join(root, "sedimenta")):
            folders[:] = [d for d in folders if d != "__pycache__"]
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(at, n), os.path.relpath(os.path.join(at, n), root))
    sc.addPyFile(f"{folder}/sedimenta.zip")
    sc._sedimenta_shipped = True
