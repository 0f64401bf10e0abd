"""Session settings and the shared folder for tables that a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and measurements on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", partitions).config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config(SETTING, tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where the session names none, one in its warehouse, which is shared too."""
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch").rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}/{name}"


_KEPT: dict[tuple[str, str, str], tuple[tuple, str]] = {}


def files_of(spark: SparkSession, path: str, missing_ok: bool = False) -> tuple[tuple[str, int, int], ...]:
    """Name, length and time of change of each file under a path, in order; the driver lists names only."""
    if missing_ok and not exists(spark, path):
        return ()
    listed, found = _file_system(spark, path).listFiles(_at(spark, path), True), []
    while listed.hasNext():
        file = listed.next()
        found.append((file.getPath().toString(), file.getLen(), file.getModificationTime()))
    return tuple(sorted(found))


def keep_once(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` gives from the files under the path ``source``.

    Written once by an application and read from then on, until a file of the source changes: then it is built again and
    the old one deleted, so what reads that must have run. A source that changes meanwhile is noticed by the next call.
    """
    key, now = (spark.sparkContext.applicationId, name, source), files_of(spark, source)
    before, path = _KEPT.get(key, ((), ""))
    if before != now or not exists(spark, path):
        fresh = shared_path(spark, name)
        build().write.parquet(fresh)
        _KEPT[key] = now, fresh
        if path:
            delete(spark, path)
        path = fresh
    return spark.read.parquet(path)


def _at(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _at(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _file_system(spark, path).exists(_at(spark, path))


def delete(spark: SparkSession, path: str) -> None:
    """Delete what lies at a path of a file system that Spark knows."""
    _file_system(spark, path).delete(_at(spark, path), True)


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file; false if there is one."""
    if exists(spark, path):
        return False
    try:
        out = _file_system(spark, path).create(_at(spark, path), False)
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True
