"""Session helpers: the shared work folder and tables written to it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers once a context, so that they need no copy of it on their path."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="stackweave-code-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    shutil.copytree(root, folder / "code" / root.name, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(str(folder / root.name), "zip", folder / "code"))
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without the setting gets a temporary folder of its own; on a cluster
    a missing setting is an error, for a machine-local folder would not outlive its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="stackweave-")
        atexit.register(shutil.rmtree, _own[context.applicationId], ignore_errors=True)
        context.setCheckpointDir(_own[context.applicationId])
    return "file://" + _own[context.applicationId]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone
        pass


_scopes: list[list[str]] = []


@contextmanager
def work_scope(spark: SparkSession) -> Iterator[None]:
    """Drops the tables written within it when it ends, so that a session that lives long does not pile them up.

    Results must have been read or written by then, for they read those tables.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _remove(spark, path)
            _pending.discard(path)


_pending: set[str] = set()


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed at the end of the innermost ``work_scope``, or else when the driver ends."""
    path = f"{shared_dir(spark)}/stackweave/{name}-{uuid.uuid4().hex}"
    if not _pending:
        atexit.register(lambda: [_remove(spark, p) for p in list(_pending)])
    _pending.add(path)
    if _scopes:
        _scopes[-1].append(path)
    return path


def spread(rows: DataFrame) -> DataFrame:
    """Deals ``rows`` out to all cores if the files they are read from have fewer splits than there are cores; else they stay where they are.

    For rows whose work costs far more than a shuffle of them; of tables that are large the splits are many.
    """
    splits = rows._jdf.queryExecution().toRdd().getNumPartitions()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if splits < cores else rows


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` as a Parquet table in the shared folder and reads it back.

    Unlike a cached or locally checkpointed frame the table survives the loss of executors.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
