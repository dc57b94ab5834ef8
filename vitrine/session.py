"""Session construction and the checkpoint folder.

The library never creates its own session on a cluster: operators take the
caller's DataFrames. ``build_session`` exists for tests, the bench and the CLI.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter at 100 TB: AQE re-plans joins from runtime sizes,
# splits skewed join partitions and coalesces small shuffle partitions.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # reliable checkpoints of ranking steps are removed once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(
    app: str = "vitrine",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(SCALE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    resolve_checkpoint_dir(spark)
    return spark


def resolve_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only where none is set.

    Order: the context's folder, then ``spark.checkpoint.dir`` from the
    session conf. Only a local-mode session (tests, bench) gets a fresh
    folder under the system temp dir; a cluster session without a shared
    folder is an error, because a machine-local folder would not survive the
    loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - key absent
            configured = None
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder "
                "(HDFS/S3/ABFS) before running ranking operators on a cluster"
            )
        configured = tempfile.mkdtemp(prefix="vitrine-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shared_dir(spark: SparkSession) -> str:
    """Root of the shared checkpoint folder as configured (without the
    per-context subfolder ``setCheckpointDir`` adds), so that tables and
    models derived once can be found again by later sessions."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    return resolve_checkpoint_dir(spark).rstrip("/")


def release(spark: SparkSession) -> None:
    """Free the disk of shuffles, checkpoints and cached rows nobody refers to
    any more. Spark removes them when the driver's JVM collects the objects
    that stand for them; with memory to spare that is up to half an hour later.
    What was used last may stay until the next call."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def code_version(*modules) -> str:
    """Short hash of the given modules' source: part of every derived-data
    key, so output written by older code is never reused."""
    import hashlib
    import inspect

    h = hashlib.sha1()
    for m in modules:
        h.update(inspect.getsource(m).encode())
    return h.hexdigest()[:10]


def package_version() -> str:
    """Short hash of the library's whole source (the text operators, which
    nothing else uses, aside)."""
    import hashlib
    from pathlib import Path

    root, h = Path(__file__).parent, hashlib.sha1()
    for p in sorted(root.rglob("*.py")):
        if p.relative_to(root).parts[0] != "llm":
            h.update(p.read_bytes())
    return h.hexdigest()[:10]


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return bool(fs.exists(p))


def touch(spark: SparkSession, path: str) -> None:
    """Write an empty marker file (the last step of a completed output)."""
    p, fs = _fs(spark, path)
    fs.create(p, True).close()


def publish(spark: SparkSession, root: str, build) -> str:
    """Produce a derived folder for ``root`` once and return its path.

    ``build(tmp)`` writes into a folder of its own below ``root``; a small
    pointer file, written last, names it. No rename is needed, so this holds
    on object stores too. Readers follow the smallest pointer there is:
    several writers at a time agree on one, and a folder without a pointer
    (a writer that failed) is never read."""
    import uuid

    found = _published(spark, root)
    if found:
        return found
    name = uuid.uuid4().hex
    build(f"{root}/data-{name}")
    touch(spark, f"{root}/done-{name}")
    found = _published(spark, root)
    if not found:
        raise RuntimeError(f"could not publish {root}")
    return found


def _published(spark: SparkSession, root: str) -> str | None:
    p, fs = _fs(spark, root)
    if not fs.exists(p):
        return None
    names = sorted(st.getPath().getName() for st in fs.listStatus(p))
    done = [n.removeprefix("done-") for n in names if n.startswith("done-")]
    return f"{root}/data-{done[0]}" if done else None
