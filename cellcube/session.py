"""SparkSession construction and the shared checkpoint folder.

On a cluster the checkpoint folder is whatever the cluster names in
``spark.checkpoint.dir`` (a shared filesystem); we only set our own when it is
unset, which happens in local tests.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

# Session defaults every plan in the library is designed around.
SESSION_DEFAULTS = {
    # runtime re-planning: coalesce small shuffles, split skewed join partitions,
    # turn a sort-merge join into a broadcast one when the measured side is small
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a side hash-partitioned on pixel_idx already co-locates a join on
    # (pixel_idx, t); do not re-shuffle it on both keys
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # streaming state off the JVM heap, checkpointed incrementally: state of
    # the composite grows with cells x open buckets, not with executor memory
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "cellcube", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(SESSION_DEFAULTS)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_sql_defaults(spark)
    checkpoint_dir(spark)
    return spark


def apply_sql_defaults(spark: SparkSession) -> None:
    """Runtime SQL settings the plans rely on (safe to call on any session)."""
    for k in ("spark.sql.adaptive.enabled", "spark.sql.requireAllClusterKeysForCoPartition",
              "spark.sql.session.timeZone", "spark.sql.streaming.stateStore.providerClass",
              "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"):
        spark.conf.set(k, SESSION_DEFAULTS[k])


@contextmanager
def settings(spark: SparkSession, options: dict[str, str]):
    """Session settings for what is run inside; the caller's come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a scratch one only on a local master that names none.

    On any other master an unset ``spark.checkpoint.dir`` is an error: a folder
    of our own would be a different folder on every machine."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="cellcube-ckpt-", dir="/tmp")
        _delete_on_exit(spark, configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    """Have the file system drop ``path`` when the driver's JVM ends."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(p)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, dropped when the driver ends."""
    path = f"{checkpoint_dir(spark)}/{name}-{os.urandom(8).hex()}"
    _delete_on_exit(spark, path)
    return path


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per Spark context, so that Python
    functions run there whatever directory or machine the driver started in."""
    sc = spark.sparkContext
    if getattr(sc, "_cellcube_shipped", False):
        return
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="cellcube-zip-")) / "cellcube_package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _delete_on_exit(spark, archive.parent.as_uri())
    sc._cellcube_shipped = True
