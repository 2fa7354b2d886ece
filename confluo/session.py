"""Session helpers: a local session for tests/bench and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_CKPT_KEY = "spark.checkpoint.dir"
_local_default: dict[int, str] = {}
_scratch_roots: dict[tuple[str, str], str] = {}


def build_session(master: str = "local[*]", shuffle_partitions: int | None = None,
                  app: str = "confluo", extra: dict | None = None) -> SparkSession:
    """A session configured the way the library expects (AQE on, UI off).
    ``shuffle_partitions``: Spark's own setting unless given."""
    b = SparkSession.builder.master(master).appName(app)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = (b
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .config("spark.driver.memory", "16g"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    On a cluster this is ``spark.checkpoint.dir`` (a shared file system), read
    from the session.  Only where it is unset (local tests) do we make one.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # no JVM handle (remote session): the server's setting applies
        d = spark.conf.get(_CKPT_KEY, None)
        if not d:
            raise RuntimeError("spark.checkpoint.dir is unset: set it to a folder shared by the cluster") from None
        return d
    d = sc.getConf().get(_CKPT_KEY, None)
    if not d:
        try:
            d = spark.conf.get(_CKPT_KEY, None)
        except Exception:
            d = None
    if not d and sc.getCheckpointDir():
        # set through sc.setCheckpointDir(dir): Spark appends a per-app subfolder
        d = sc.getCheckpointDir().rstrip("/").rsplit("/", 1)[0]
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: set it to a folder shared by the cluster")
        key = id(sc._jsc)
        if key not in _local_default:
            _local_default[key] = tempfile.mkdtemp(prefix="confluo-ckpt-")
        d = _local_default[key]
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared work folder.  All of a session's
    scratch lies in one folder there, which goes when the driver ends."""
    root = work_dir(spark).rstrip("/")
    sc = spark.sparkContext
    key = (sc.applicationId, root)
    if key not in _scratch_roots:
        folder = f"{root}/confluo-{sc.applicationId}-{uuid.uuid4().hex[:8]}"
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _scratch_roots[key] = folder
    return f"{_scratch_roots[key]}/{name}-{uuid.uuid4().hex[:12]}"


def reliable_checkpoint(df):
    """Cut lineage with a reliable checkpoint in the shared folder."""
    work_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written_table(df, name: str = "table"):
    """``df`` written to the shared folder and read again.  Unlike a checkpoint,
    which hands on the plan's size estimates (in a loop of joins their product
    grows without end), the table is planned by the size of its files."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Jobs submitted at the same time by :func:`run_concurrently`.
MOST_CONCURRENT = 8


def run_concurrently(fn, items: list) -> list:
    """``[fn(x) for x in items]`` with the calls' Spark jobs submitted from up
    to :data:`MOST_CONCURRENT` threads, so independent jobs (one per table)
    overlap on the cluster.  The caller's local properties go with them."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    items = list(items)
    if len(items) < 2:
        return [fn(x) for x in items]
    session = SparkSession.getActiveSession()
    target = inheritable_thread_target(session) if session else inheritable_thread_target
    with ThreadPoolExecutor(min(MOST_CONCURRENT, len(items))) as pool:
        return list(pool.map(target(fn), items))
