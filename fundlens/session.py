"""Session helpers: a tuned local session for tests/bench and the shared checkpoint folder.

On a cluster the caller owns the session; the library only reads its settings.
"""

from __future__ import annotations

import contextlib
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every entry point of the library relies on (ANSI-safe expressions are used
# throughout, so ANSI mode may stay on).
_LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # the fund-level plans are wide projections of nested CASE expressions; inferring constraints
    # through every alias grows combinatorially in planning time and buys nothing here
    "spark.sql.constraintPropagation.enabled": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "fundlens",
                  driver_memory: str = "16g") -> SparkSession:
    """Session for tests and the benchmark (``local[cores]``)."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", driver_memory))
    for k, v in _LOCAL_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names in ``spark.checkpoint.dir`` (None if unset)."""
    d = spark.sparkContext.getCheckpointDir()
    if d:
        return d
    return spark.conf.get("spark.checkpoint.dir", None) or None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder; create one only for local sessions where it is unset.

    A cluster session must name a shared folder in ``spark.checkpoint.dir``; a machine-local
    temporary folder is never used there.
    """
    d = checkpoint_dir(spark)
    if d:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(d)
        return spark.sparkContext.getCheckpointDir() or d
    master = spark.sparkContext.master or ""
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; name a shared folder for this cluster")
    d = tempfile.mkdtemp(prefix="fundlens-ckpt-")
    spark.sparkContext.setCheckpointDir(d)
    return spark.sparkContext.getCheckpointDir() or d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably in the checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written intermediate tables."""
    import uuid

    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/scratch-{name}-{uuid.uuid4().hex[:12]}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing ``df`` as parquet to a fresh folder under the shared checkpoint
    folder and reading it back. Unlike ``checkpoint()`` the result carries no constraints of the
    original plan, which keeps planning cheap for wide, deeply nested projections; partition
    identity is not preserved (use ``cut_lineage`` where it matters)."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


@contextlib.contextmanager
def open_writers(spark: SparkSession, n: int = 64):
    """Within it, a partitioned write keeps up to ``n`` files open in a task, whose rows are then not
    sorted by the partition columns (a sort holds them in memory or spills them)."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, size: int):
    """Within it, a batch of rows on its way to a Python worker holds about ``size`` bytes: rows of large
    binary values else fill batches of 64 MB, in the JVM and in the worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``fundlens`` importable in the Python workers (pandas UDFs refer to its functions).

    Once per application the package sources are zipped into the checkpoint folder and added with
    ``addPyFile``. On a cluster whose checkpoint folder is not a local path, deploy the package
    with ``--py-files`` instead; nothing is done here."""
    import os
    import uuid
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    base = ensure_checkpoint_dir(spark)
    if "://" in base and not base.startswith("file:"):
        _SHIPPED.add(app)
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = base[len("file:"):] if base.startswith("file:") else base
    path = os.path.join(root, f"fundlens-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(path)
    _SHIPPED.add(app)
