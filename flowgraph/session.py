"""Session settings and the shared scratch folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL_SCRATCH: dict[str, str] = {}
_MADE: dict[str, list[str]] = {}
_SHARED: set[tuple[str, str]] = set()


def build_session(app_name: str = "flowgraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC, which dates need; all other settings are the cluster's, or ``conf``."""
    builder = SparkSession.builder.appName(app_name).config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, taken from ``spark.checkpoint.dir``.

    On a cluster a path of the local file system may be a mount that all
    machines share or a folder of one machine; the first use finds out which,
    and the latter is refused.  Only a local-mode session may fall back to a
    temporary folder of its own; on a cluster such a folder would be lost with
    its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    local = sc.master.startswith("local")
    if configured:
        folder = configured.rstrip("/")
        if not local and _filesystem(spark, configured)[0].getUri().getScheme() == "file":
            _require_shared(spark, folder)
        return folder
    if not local:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    if sc.applicationId not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[sc.applicationId] = tempfile.mkdtemp(prefix="flowgraph-")
    return _LOCAL_SCRATCH[sc.applicationId]


def _require_shared(spark: SparkSession, folder: str) -> None:
    """An error unless what the executors write to ``folder`` can be read back whole; asked once for each application."""
    key = (spark.sparkContext.applicationId, folder)
    if key in _SHARED:
        return
    probe = f"{folder}/flowgraph-{uuid.uuid4().hex}"
    try:
        shared = _reads_back(spark, probe)
    except Exception as why:  # whatever stops a small job there would stop every job
        raise ValueError(f"{folder} can't be written and read by all executors") from why
    if not shared:
        raise ValueError(f"{folder} is a folder of one machine; executors elsewhere can't reach it")
    _SHARED.add(key)


def _reads_back(spark: SparkSession, path: str) -> bool:
    """Whether a row of each of twice as many tasks as there are cores, written to ``path``, is found there again."""
    tasks = 2 * spark.sparkContext.defaultParallelism
    rows = spark.range(0, tasks, 1, tasks)
    try:
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path).count() == tasks
    finally:
        filesystem, where = _filesystem(spark, path)
        filesystem.delete(where, True)


def _filesystem(spark: SparkSession, path: str):
    """The file system of a path and the path, as the JVM's objects."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def path_exists(spark: SparkSession, path: str) -> bool:
    filesystem, where = _filesystem(spark, path)
    return filesystem.exists(where)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the scratch folder that no other run uses."""
    folder = f"{scratch_dir(spark)}/flowgraph-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return f"{folder}/{name}"


def discard(spark: SparkSession, path: str) -> None:
    """Remove the scratch folder that ``path`` lies in, once nothing will read it any more."""
    folder = next((f for f in _MADE.get(spark.sparkContext.applicationId, []) if path.startswith(f"{f}/")), None)
    if folder:
        _MADE[spark.sparkContext.applicationId].remove(folder)
        filesystem, where = _filesystem(spark, folder)
        filesystem.delete(where, True)


def cleanup(spark: SparkSession) -> int:
    """Remove this application's intermediate tables; frames that read them can't be used afterwards."""
    folders = _MADE.pop(spark.sparkContext.applicationId, [])
    for folder in folders:
        filesystem, where = _filesystem(spark, folder)
        filesystem.delete(where, True)
    return len(folders)


def as_stored(writer, lookup: tuple[str, ...] = ()):
    """Options of every table that is kept: compressed by zstd, with bloom filters of the ``lookup`` columns.

    Most bytes of a graph are ids in hex digits, which have nothing that repeats: only a codec that gives a digit half
    a byte makes them smaller, and snappy and lz4 do not.  The filters spare a lookup the files without the value.
    """
    writer = writer.option("compression", "zstd")
    for c in lookup:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    return writer


def materialise(
    df: DataFrame, name: str, partition_by: str | None = None, lookup: tuple[str, ...] = ()
) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; ``lookup`` columns get bloom filters.

    This cuts the lineage of iterative jobs, survives lost executors, and
    leaves Catalyst with the true size of the table, so that it broadcasts a
    table only after its size is known.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = as_stored(df.write.mode("errorifexists"), lookup)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def still_there(df: DataFrame) -> bool:
    """Whether a stored table that ``df`` reads has its files yet; ``cleanup``, or whoever clears the folder, takes them."""
    files = df.inputFiles()
    return not files or path_exists(df.sparkSession, files[0])


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``materialise``, and the number of rows, counted while they are written."""
    seen = Observation()
    stored = materialise(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return stored, seen.get["n"]
