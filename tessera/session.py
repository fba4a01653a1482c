"""Session helpers: building a session for tests/bench, and shared scratch paths.

On a cluster the session is created by the platform; the library only reads
``spark.checkpoint.dir`` from it.  A checkpoint directory of our own is set only
when the session has none (local runs and tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tessera") -> SparkSession:
    """Return the active session or build a local one with sane defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or cpus
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "16g"))
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint directory, setting one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder; it is used
    as is; a cluster session without it is refused.  Local runs get a fresh
    temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="tessera-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def ship_package(spark: SparkSession) -> None:
    """Make ``tessera`` importable in Python workers, once per context.

    Python tasks (``mapInPandas`` closures) import helpers from the package.
    Workers do not see the driver's ``sys.path``, so the package is zipped
    into the shared checkpoint folder and added with ``addPyFile`` (which
    ships it to every executor, and to local workers alike).
    """
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    import io
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for folder, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    zf.write(full, os.path.relpath(full, root))
    target = scratch_path(spark, "pyfiles") + "/tessera.zip"
    jvm = sc._jvm
    dst = jvm.org.apache.hadoop.fs.Path(target)
    out = dst.getFileSystem(sc._jsc.hadoopConfiguration()).create(dst, True)
    try:
        out.write(bytearray(buf.getvalue()))
    finally:
        out.close()
    sc.addPyFile(target)
    sc._tessera_shipped = True
    sc._tessera_pyfile = target


def memo_column(spark: SparkSession, key: tuple, build):
    """Build a Column expression once per SparkContext and reuse it.

    Large expressions (the chunker levels, the cleaner) cost thousands of
    py4j calls to build; they refer to columns by name, so one object
    serves every DataFrame of the session.
    """
    sc = spark.sparkContext
    cache = getattr(sc, "_tessera_columns", None)
    if cache is None:
        cache = {}
        sc._tessera_columns = cache
    if key not in cache:
        cache[key] = build()
    return cache[key]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path below the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tessera-{name}-{uuid.uuid4().hex[:12]}"


def ensure_parallelism(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Spread a scan that came back as too few partitions.

    Large inputs already split into many partitions at the scan
    (``spark.sql.files.maxPartitionBytes``) and are left alone, so no shuffle
    is added at scale; a small file with one row group is spread round-robin
    before per-row text work.
    """
    spark = df.sparkSession
    want = min_partitions or spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < want:
        return df.repartition(want)
    return df
