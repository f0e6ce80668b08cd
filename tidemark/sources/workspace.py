"""Written intermediate tables in the shared folder named by ``spark.checkpoint.dir``.

Writing an intermediate result does two things that matter on a big cluster: a lost executor
never forces the whole lineage to be recomputed, and the planner learns the true size of the
table, so it broadcasts a lookup side only when its files are below
``spark.sql.autoBroadcastJoinThreshold`` and shuffles both sides otherwise.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_memo: dict[tuple, str] = {}
_locks: dict[tuple, threading.Lock] = {}
_guard = threading.Lock()


def root(spark: SparkSession) -> str:
    """The shared folder of this session.

    A folder of the process's own, removed at its end, stands in only where the setting is missing
    and the master is local.
    """
    folder = spark.conf.get(_SETTING, None)
    if not folder:
        app = (spark.sparkContext.applicationId, "__root__")
        with _guard:
            if app not in _memo:
                if not spark.sparkContext.master.startswith("local"):
                    raise RuntimeError(f"{_SETTING} must name a folder all executors can reach")
                _memo[app] = tempfile.mkdtemp(prefix="tidemark-")
                atexit.register(shutil.rmtree, _memo[app], ignore_errors=True)
            folder = _memo[app]
    return f"{folder.rstrip('/')}/tidemark-{spark.sparkContext.applicationId}"


def _files(spark: SparkSession, folder: str):
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def exists(spark: SparkSession, folder: str) -> bool:
    files, path = _files(spark, folder)
    return files.exists(path)


def clear(spark: SparkSession) -> None:
    """Delete everything this application has written; tables read from there are gone."""
    files, path = _files(spark, root(spark))
    files.delete(path, True)
    with _guard:
        for slot in [s for s in _memo if s[0] == spark.sparkContext.applicationId and s[1] != "__root__"]:
            del _memo[slot]


def listing(spark: SparkSession, folder: str) -> tuple:
    """Name, bytes and time of each table below a folder: it changes when a source does."""
    files, path = _files(spark, folder)
    return tuple(sorted((s.getPath().getName(), files.getContentSummary(s.getPath()).getLength(),
                         s.getModificationTime()) for s in files.listStatus(path)))


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` and return a reader over the written files."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the files of a table that ``materialise`` has written and nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        files, path = _files(table.sparkSession, folder)
        files.delete(path, True)


class Parts:
    """A written table in one folder per value of a column, so that the planner sizes each value's
    rows on their own. (It takes a table read with a partition filter at its full size.)"""

    def __init__(self, df: DataFrame, label: str, column: str):
        self.spark, self.column = df.sparkSession, column
        self.path = fresh_path(self.spark, label)
        self.schema = df.drop(column).schema
        self.columns = df.columns
        df.write.mode("error").partitionBy(column).parquet(self.path)

    def of(self, value: str) -> DataFrame:
        """The rows of one value, without the column; none if the value does not occur."""
        files, path = _files(self.spark, f"{self.path}/{self.column}={value}")
        if not files.exists(path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(str(path))


def part(table: DataFrame | Parts, column: str, value: str) -> DataFrame:
    """Rows of one value of a plain or a split table, without the column."""
    if isinstance(table, Parts):
        return table.of(value)
    return table.where(table[column] == value).drop(column)


def shared(spark: SparkSession, key: str, build: Callable[[], DataFrame],
           partition_by: list[str] | None = None) -> DataFrame:
    """Build and write a table once per application and state of its sources.

    ``key`` is a name, a colon and the folder of the source tables; later calls read the written
    files while that folder's listing stays the same.
    """
    slot = (spark.sparkContext.applicationId, key, listing(spark, key.split(":", 1)[1]))
    with _guard:
        lock = _locks.setdefault(slot, threading.Lock())
    with lock:
        if slot not in _memo:
            df = build()
            path = fresh_path(spark, "shared")
            writer = df.write.mode("error")
            if partition_by:
                writer = writer.partitionBy(*partition_by)
            writer.parquet(path)
            _memo[slot] = path
    return spark.read.parquet(_memo[slot])
