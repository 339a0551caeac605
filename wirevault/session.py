"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Settings that affect results, not speed. Everything else is left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}

_CHECKPOINT_DIR = "spark.checkpoint.dir"
_local_folders: dict[str, str] = {}
# Fixed value: the setting by which a job deletes its shuffle files at its end. Else they stay until the driver
# happens to collect its garbage, and the disk holds those of all earlier steps as well.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_dropping = threading.Lock()
_users: dict[str, tuple[int, str | None]] = {}  # per session: writers inside, the setting before


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings this package relies on to a running session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session that names none gets a folder of its own, because a
    machine-local folder is not visible to the executors of a cluster.
    """
    configured = spark.conf.get(_CHECKPOINT_DIR, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_CHECKPOINT_DIR} to a folder that all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="wirevault-")
    return _local_folders[app]


def new_scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the shared scratch folder; nothing is ever reused."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists on whatever file system the path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that this package wrote and no longer needs."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def make_folder(spark: SparkSession, path: str) -> None:
    """See that a folder exists."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Jobs that are planned within leave no shuffle files behind. For results that are written and read again."""
    session = spark._jsparkSession.sessionUUID()
    with _dropping:
        users, before = _users.get(session) or (0, spark.conf.get(_DROP_SHUFFLES, None))
        _users[session] = users + 1, before
        spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        with _dropping:
            users, before = _users.pop(session)
            if users > 1:
                _users[session] = users - 1, before
            elif before is None:
                spark.conf.unset(_DROP_SHUFFLES)
            else:
                spark.conf.set(_DROP_SHUFFLES, before)


def stored_once(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """Compute a narrow intermediate result once, in the shared scratch folder; and its row count.

    The count is what decides about a broadcast: the optimiser's own estimate of a derived
    table is far off, and adaptive execution learns the size only after the other side
    has been shuffled.
    """
    seen = Observation()
    path = new_scratch_dir(df.sparkSession, label)
    with shuffles_dropped(df.sparkSession):
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["n"]
