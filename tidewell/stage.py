"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a session that names none (local tests) gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    own = spark.sparkContext.getCheckpointDir()
    if own:
        return own
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="tidewell-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends there and a lost
    executor costs no more than a re-read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tidewell-{uuid.uuid4().hex}-{label}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def adopt(spark: SparkSession, path: str) -> None:
    """A folder that something else wrote to the shared folder, to be deleted with the session's tables."""
    _WRITTEN.append((spark, path))


def mark() -> int:
    """A point in the order of materialize() calls, for settle()."""
    return len(_WRITTEN)


def discard(spark: SparkSession, since: int) -> None:
    """Deletes the tables written since that point but for the last: nothing reads them any more."""
    release(spark, [path for _, path in _WRITTEN[since:-1]])


def settle(df: DataFrame, label: str, since: int) -> DataFrame:
    """materialize(df), after which the tables written since that point are deleted: df was their reader."""
    out = materialize(df, label)
    discard(df.sparkSession, since)
    return out


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Deletes tables that materialize() wrote in this session (all, or these), once their readers are done."""
    jvm = spark.sparkContext._jvm
    for s, path in list(_WRITTEN):
        if paths is None or path in paths:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
            _WRITTEN.remove((s, path))


def _at_exit() -> None:
    """What queries left in the shared folder goes when the driver ends."""
    for s, path in list(_WRITTEN):
        try:
            release(s, [path])
        except Exception:  # the session has ended before
            if path.startswith(("file:" + tempfile.gettempdir(), tempfile.gettempdir())):
                shutil.rmtree(path.removeprefix("file:"), ignore_errors=True)


atexit.register(_at_exit)
