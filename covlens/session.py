"""Session helpers: the shared folder for written tables, and a local session for tests."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

_LOCK = threading.Lock()


_LOCAL_DIRS: dict[str, str] = {}


def _context(spark: SparkSession):
    """The SparkContext, or None for a session without one (Spark Connect)."""
    try:
        return spark.sparkContext
    except Exception:
        return None


def app_id(spark: SparkSession) -> str:
    sc = _context(spark)
    return sc.applicationId if sc is not None else spark.conf.get("spark.app.id", "connect")


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder for tables this library writes (fixtures, rollups).

    It is the folder named by ``spark.checkpoint.dir``. Only a local session
    that names none is given a fresh local folder; on a cluster, whose
    executors would each write to their own disk, that is an error.
    """
    with _LOCK:
        sc = _context(spark)
        current = sc.getCheckpointDir() if sc is not None else None
        if not current:
            current = spark.conf.get("spark.checkpoint.dir", None)
        if not current:
            master = sc.master if sc is not None else ""
            if not (master == "local" or master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            key = app_id(spark)
            current = _LOCAL_DIRS.setdefault(key, tempfile.mkdtemp(prefix="covlens-"))
            if sc is not None:
                sc.setCheckpointDir(current)
                current = sc.getCheckpointDir()
        return current.rstrip("/")


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A new, unused path under the shared folder."""
    return f"{shared_dir(spark)}/covlens/{kind}/{uuid.uuid4().hex}"


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for what runs within; the session's own come back after it."""
    before = {k: spark.conf.get(k, None) for k in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


#: For a write whose rows are read back from its files: Spark removes the write's shuffle files when it ends.
FREED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "covlens") -> SparkSession:
    """A local session configured like the cluster profile, for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark
