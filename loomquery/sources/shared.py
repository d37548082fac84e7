"""Tables that Spark derives and reads again: in the folder that all executors share, under the application's own name."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_temporary: list[str] = []
_own: set[str] = set()
_derived: dict[tuple[str, str], str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only for a local master that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _temporary:
        _temporary.append(tempfile.mkdtemp(prefix="loomquery-"))
        atexit.register(shutil.rmtree, _temporary[0], ignore_errors=True)
    return f"file://{_temporary[0]}"


def _remove_at_exit(jvm, path: str, conf) -> None:
    try:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    except Exception:  # the JVM went first: what is left is scratch, under this application's name
        pass


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; an application's paths go when its driver ends."""
    own = f"{shared_root(spark)}/loomquery-derived/{spark.sparkContext.applicationId}"
    if own not in _own:
        _own.add(own)
        atexit.register(_remove_at_exit, spark._jvm, own, spark._jsc.hadoopConfiguration())
    return f"{own}/{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once and read back: its lineage is cut, and every reader sees the same rows."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def signature(spark: SparkSession, df: DataFrame) -> str:
    """What tells one state of a table's files from another: their paths, lengths and times."""
    conf, lines = spark._jsc.hadoopConfiguration(), []
    for f in sorted(df.inputFiles()):
        place = spark._jvm.org.apache.hadoop.fs.Path(f)
        status = place.getFileSystem(conf).getFileStatus(place)
        lines.append(f"{f} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def derived(spark: SparkSession, source: DataFrame, name: str, build) -> str:
    """The path of what ``build(path)`` makes of a table, made once for each application and state of the table's files."""
    key = (spark.sparkContext.applicationId, f"{name} {signature(spark, source)}")
    if key not in _derived:
        path = shared_path(spark, name)
        build(path)
        _derived[key] = path
    return _derived[key]
