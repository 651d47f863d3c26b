"""Spark session and shared-folder helpers.

Library code never creates its own session; it takes the caller's.  The
helpers here are for tests, the bench and the command line.
"""

from __future__ import annotations

import gc
import os
import tempfile
import threading
import zipfile

from pyspark.sql import SparkSession

# Settings every run should have.  AQE re-plans joins and coalesces small
# shuffle partitions at run time; skew-join splits hot partitions.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # the per-client summary is one aggregate with ~60 buffers; keep it
    # inside whole-stage code generation
    "spark.sql.codegen.maxFields": "400",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "meterwise", extra: dict | None = None) -> SparkSession:
    """A local session for tests and the bench (never used on a cluster)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("METERWISE_DRIVER_MEMORY", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the operator of the cluster sets it to a shared file system;
    we read it from the session.  Only when it is unset (local tests) do we
    choose a fresh scratch folder ourselves.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS / object store) "
                               "before running meterwise on a cluster")
        d = tempfile.mkdtemp(prefix="meterwise-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    import uuid
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, *parts[:-1], f"{parts[-1]}-{uuid.uuid4().hex[:12]}") if parts else \
        os.path.join(base, uuid.uuid4().hex)


def cut_lineage(df, name: str = "table"):
    """Write ``df`` as a Parquet table in the shared checkpoint folder and
    read it back.

    The plan runs once (``Dataset.checkpoint`` would compute it twice unless
    cached), the result survives executor loss, later stages restart from
    the files, and AQE sees the real file size when it plans joins.
    """
    path = shared_path(df.sparkSession, "tables", name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def drop_garbage(spark: SparkSession) -> None:
    """Collect the driver's garbage, Python's and the JVM's: Spark's cleaner removes shuffles and
    broadcasts of ended jobs only when their handles are collected, and a heap that has grown
    for one job shrinks again only then.  For operators that run many jobs in a row."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_SHIPPED: set[str] = set()
_SHIPPING = threading.Lock()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package once per application, wherever they were started.

    Jobs that run side by side wait for the first of them: a cluster's file server takes a
    name once only and fails the job that brings it again from another folder."""
    app = spark.sparkContext.applicationId
    with _SHIPPING:
        if app in _SHIPPED:
            return
        root = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(), "meterwise_package.zip")
        with zipfile.ZipFile(target, "w") as z:
            for folder, _, names in os.walk(root):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        spark.sparkContext.addPyFile(target)
        _SHIPPED.add(app)
