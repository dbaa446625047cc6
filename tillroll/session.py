"""Session settings for local runs (tests, bench). Library functions never
change session configuration; on a cluster the job's own session is used.

Settings that matter at scale, and why:
- AQE on, with partition coalescing and skew-join splitting: join strategy
  is chosen from measured sizes (broadcast only under the threshold), and a
  shuffle partition holding a hot key is split across tasks.
- Python call-site capture off: it costs a JVM round trip per API call
  while a plan is built; errors still carry the JVM-side context.
- ``spark.checkpoint.dir``: respected when the cluster sets it; only a session of
  this process alone (``local[n]``) gets a fresh scratch folder without one.
"""

from __future__ import annotations

import gc
import os
import tempfile
import time
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", memory: str = "8g", shuffle_partitions: int | None = None,
                  app: str = "tillroll", extra: dict[str, str] | None = None) -> SparkSession:
    n = shuffle_partitions or (8 if cpus == "*" else max(2, 2 * int(cpus)))
    b = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.driver.memory", memory)
         .config("spark.sql.shuffle.partitions", str(n))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         # no Python call-site capture per API call (a JVM round trip each)
         .config("spark.python.sql.dataFrameDebugging.enabled", "false"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The configured checkpoint folder. A session that runs in this process alone gets a fresh
    scratch folder where none is set; on a cluster that is an error, as executors and driver
    have to share the folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="tillroll-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return path


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's code to the executors once per application (no data goes this way)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tillroll-code-"), "tillroll-code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def written(df: DataFrame) -> DataFrame:
    """The rows written to the checkpoint folder and read back: later jobs reread
    them instead of replaying the plan, also after an executor is lost."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release_shuffles(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of finished jobs once the driver has collected the plans
    that made them, by default every half an hour; here it is asked to, so that they do not
    stand beside the next job's. Nothing that is still in use goes."""
    for wait in (0.2, 1.0):  # a plan is held until Spark's listeners have heard of its end
        time.sleep(wait)
        gc.collect()  # Python's last handles on it
        spark.sparkContext._jvm.System.gc()
