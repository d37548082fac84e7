"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs without these bytes; bytes.split() splits at exactly them.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD_PATTERN = rf"[^{SPACE_CLASS}]+"

BATCH_ROWS = 1000

#: The bound on the marks of heavy keys that spread_join sends to the tasks.
MARKS = 1 << 16

_local_scratch: list[str] = []
_own_scratch: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only for a local master that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _local_scratch:
        _local_scratch.append(tempfile.mkdtemp(prefix="loomquery-"))
        atexit.register(shutil.rmtree, _local_scratch[0], ignore_errors=True)
    return f"file://{_local_scratch[0]}"


def _delete(jvm, path: str, conf) -> None:
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(conf).delete(place, True)


def _delete_at_exit(jvm, path: str, conf) -> None:
    try:
        _delete(jvm, path, conf)
    except Exception:  # the JVM went first: what is left is scratch, under this application's name
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table or a set of files in the shared folder. All paths of an application lie in one folder, which goes when the driver's process ends."""
    own = f"{scratch_root(spark)}/loomquery/{spark.sparkContext.applicationId}"
    if own not in _own_scratch:
        _own_scratch.add(own)
        atexit.register(_delete_at_exit, spark._jvm, own, spark._jsc.hadoopConfiguration())
    return f"{own}/{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder once and read it back: the lineage is cut, and every reader sees the same rows."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomquery_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing will read again: all that came of them has been written."""
    for t in tables:
        path = t.__dict__.pop("_loomquery_path", None)
        if path:
            _delete(t.sparkSession._jvm, path, t.sparkSession._jsc.hadoopConfiguration())


def spread_join(rows: DataFrame, facts: DataFrame, key: str, heavy: DataFrame | None, by: str, how: str = "inner") -> DataFrame:
    """rows joined with facts, which has one row for each key, where the keys in ``heavy`` may have any number of rows.

    Rows of a heavy key are dealt to all partitions by ``by``, and its fact is copied to each. Which keys are heavy is told by hash values, of which there are at most
    MARKS; a key that shares the hash value of a heavy one is spread too. Where nothing is heavy this is a plain join.
    """
    mark = F.pmod(F.xxhash64(key), F.lit(MARKS)).cast("int")
    marks = [] if heavy is None else [r[0] for r in heavy.select(mark).distinct().collect()]
    if not marks:
        return rows.join(facts, key, how)
    n, spread = n_partitions(rows.sparkSession), mark.isin(marks)
    salted = rows.withColumn("_salt", F.when(spread, F.pmod(F.xxhash64(by), F.lit(n))).otherwise(0).cast("int"))
    copied = facts.withColumn("_salt", F.explode(F.when(spread, F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(copied, [key, "_salt"], how).drop("_salt")


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, wherever the driver runs from."""
    sc = spark.sparkContext
    if getattr(sc, "_loomquery_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="loomquery-pkg-")  # executors fetch it from the driver at their first task
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "loomquery_pkg.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, f"{package.name}/{p.relative_to(package)}")
    sc.addPyFile(archive)
    sc._loomquery_shipped = True


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Hand memory that a task has freed back to the system: a worker process lives on into other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, at_end: Callable[[], None] = give_back) -> DataFrame:
    """Arrow batches through fn, one out for one in, some hundred rows at a time: long texts then don't pile up. at_end runs after a task's last batch."""
    ship_package(df.sparkSession)

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, BATCH_ROWS):
                yield fn(b.slice(a, BATCH_ROWS))
        at_end()

    return df.mapInArrow(run, schema)


def keyed_texts(docs: DataFrame) -> DataFrame:
    """Only what an operator on texts reads, under fixed names: extra columns can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
