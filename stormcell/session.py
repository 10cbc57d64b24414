"""Session factory and the shared scratch folder.

Lineage is cut with ``DataFrame.checkpoint()`` or with tables written under the
folder the cluster names in ``spark.checkpoint.dir``.  A folder of our own is
only created when that setting is missing and the master is local (tests,
benchmarks on one machine); on a cluster a missing setting is an error.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # wall-clock hours matter (rush hour, day cut): timestamps stay
    # timestamp_ntz and literals are parsed from text, so results do not
    # depend on the session zone (checked by running the oracle under another)
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoints in the shared folder are removed once no plan refers to them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


# Applied on a cluster master only, and only where the cluster has not set
# its own value: many shuffle partitions that AQE coalesces to ~256 MB each,
# and 256 MB scan splits, so a partition fits an executor's memory at scale.
CLUSTER_DEFAULTS = {
    "spark.sql.shuffle.partitions": ("200", "4096"),
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": ("64MB", "256MB"),
    "spark.sql.files.maxPartitionBytes": ("128MB", "256MB"),
}


def get_session(master: str | None = None, app: str = "stormcell",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if not _is_local(spark):
        for key, (default, value) in CLUSTER_DEFAULTS.items():
            if key not in conf and spark.conf.get(key, default) in (default, None):
                spark.conf.set(key, value)
    checkpoint_root(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Read from the session (``spark.checkpoint.dir`` or the context's checkpoint
    dir).  Only when unset and running locally is a fresh folder created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not _is_local(spark):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder")
    local = tempfile.mkdtemp(prefix="stormcell-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def checkpoint(df, eager: bool = True):
    """``df.checkpoint()`` into the shared folder (resolved from the session
    first, so library calls work without an explicit setup step)."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=eager)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    root = checkpoint_root(spark)
    return os.path.join(root, f"{name}-{uuid.uuid4().hex[:12]}")


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


LANDING_VERSION = 5  # bump when a landing format changes, so old copies are not reused


def source_state(spark: SparkSession, source: str) -> tuple[str, str]:
    """The qualified address of a folder, and a fingerprint of what is in it:
    name, bytes, files and modification time of every entry, as the source's
    own file system gives them."""
    import hashlib
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(source)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    path = path.makeQualified(fs.getUri(), fs.getWorkingDirectory())
    found = []
    for entry in fs.listStatus(path):
        size = fs.getContentSummary(entry.getPath())
        found.append((entry.getPath().getName(), size.getLength(), size.getFileCount(),
                      entry.getModificationTime()))
    return path.toString(), hashlib.md5(repr(sorted(found)).encode()).hexdigest()[:12]


def landed_path(spark: SparkSession, name: str, source: str) -> str:
    """Path for a copy derived from the folder ``source``: one per address and
    state of the source, so a source that changes is landed anew."""
    import hashlib
    base = os.path.dirname(checkpoint_root(spark).rstrip("/"))
    address, state = source_state(spark, source)
    tag = hashlib.md5(address.encode()).hexdigest()[:12]
    return os.path.join(base, "landed", f"{name}-v{LANDING_VERSION}-{tag}", state)


def land_once(spark: SparkSession, path: str, write, refresh: bool = False,
              marker: str = "_SUCCESS") -> str:
    """Run ``write(path)`` unless a completed copy (``marker``) is there
    (``refresh`` writes it again; the writers overwrite).  Copies of older
    states of the same source are removed once the new one is complete."""
    if refresh or not path_exists(spark, os.path.join(path, marker)):
        write(path)
        jvm = spark.sparkContext._jvm
        here = jvm.org.apache.hadoop.fs.Path(path)
        fs = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for entry in fs.listStatus(here.getParent()):
            if entry.getPath().getName() != here.getName():
                fs.delete(entry.getPath(), True)
    return path
