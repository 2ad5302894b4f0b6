"""Session settings the engine relies on, and the shared scratch folder."""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime settings; none of them touches cluster sizing, which stays with the
# deployment (executors, shuffle partitions, scan split size).
SETTINGS = {
    # Dates, hours and windows are UTC.
    "spark.sql.session.timeZone": "UTC",
    # Casts of bad text fail loudly; the lenient form is try_cast, by name.
    "spark.sql.ansi.enabled": "true",
    # In a JSON object with a repeated key the last value counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Session and dedup state outgrows the heap; keep it off-heap and ship
    # changelogs rather than whole snapshots.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Counting the rows of a store costs a lookup per write.
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    # Pre-merge sessions before the shuffle, so that one very busy user does
    # not send every row to a single task.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session and return it."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


# Settings that results depend on, not only resources.
NEEDED = ("spark.sql.session.timeZone", "spark.sql.ansi.enabled",
          "spark.sql.variant.allowDuplicateKeys")


def require_configured(spark: SparkSession) -> None:
    """Fail early on a session whose settings would change results."""
    wrong = [k for k in NEEDED if spark.conf.get(k, None) != SETTINGS[k]]
    if wrong:
        raise ValueError(f"call millrace.configure(spark) first; not as needed: {', '.join(wrong)}")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only a session within one process may fall back to a temporary folder of
    its machine, which goes when the process ends.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        return _own_dir()
    raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")


@functools.cache
def _own_dir() -> str:
    path = tempfile.mkdtemp(prefix="millrace-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under `shared_dir`, never used before."""
    return f"{shared_dir(spark)}/millrace/{label}-{uuid.uuid4().hex}"
