"""A keyed table that grows by deltas: upserts and deletes append, a log of manifests publishes, readers merge, compaction rewrites.

A batch is written as one delta, its rows in folders by a hash of the key, so what it costs follows its own size. It exists for readers once the log has the next manifest, a small file that names the
deltas of each folder; a manifest is published by a rename that fails where another writer was first, who is then taken into account. A crash leaves files that no manifest
names, and ``vacuum`` removes them. Readers merge on read: of one key the row with the highest version counts, and of equal versions the later delta's; a delete is a row of its own.

A stream's batch carries its name and number into the manifest, so one that runs again changes nothing.

Ledgers are sums that follow the table. A batch adds to each the sums over what it makes true less the sums over what it replaces, for which only the folders of its own keys are read; the sums of all
deltas are those over the whole table, and are published by the same manifest.

Defined results: a null key is a key; a null version comes before all others; rows of one batch that share a key count as one, that of the highest version (of equal ones any); a batch may add columns, which
older rows have as null; an empty batch publishes a manifest without a delta.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

BUCKET, DELTA, DELETED, SEQ = "_store_bucket", "_store_delta", "_store_deleted", "_store_seq"
BUCKETS = 16
MIN_DELTAS = 8
RETENTION_S = 3600.0


@dataclass(frozen=True)
class Ledger:
    """Sums that follow a table: ``make`` turns rows with a column ``sign`` (1 or -1) into keys and sums of what each row counts, times its sign."""

    name: str
    keys: tuple[str, ...]
    sums: tuple[str, ...]
    make: Callable[[DataFrame], DataFrame]


class Conflict(Exception):
    """Another writer published this number first."""


class Log:
    """Numbered manifests in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self._path(folder).getFileSystem(self.conf)

    def _path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def names(self, folder: str) -> list[str]:
        place = self._path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(place)] if self.fs.exists(place) else []

    def numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.names(self.folder) if n.endswith(".json") and not n.startswith("."))

    def read(self, number: int) -> dict:
        stream = self.fs.open(self._path(f"{self.folder}/{number:020d}.json"))
        try:
            return json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def last(self) -> dict | None:
        known = self.numbers()
        return self.read(known[-1]) if known else None

    def publish(self, manifest: dict) -> None:
        """Write the manifest beside its place and rename it there; a place that is taken is a Conflict."""
        made = self._path(f"{self.folder}/.{uuid.uuid4().hex}.tmp")
        out = self.fs.create(made, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        place = self._path(f"{self.folder}/{manifest['number']:020d}.json")
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        plain = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)  # without the option to overwrite
        try:
            context.rename(self.fs.makeQualified(made), self.fs.makeQualified(place), plain)
        except Exception as e:
            self.fs.delete(made, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(manifest["number"]) from None
            raise

    def delete(self, p: str) -> None:
        self.fs.delete(self._path(p), True)

    def changed(self, p: str) -> float:
        return self.fs.getFileStatus(self._path(p)).getModificationTime() / 1000

    def length(self, p: str) -> int:
        return self.fs.getContentSummary(self._path(p)).getLength()


class KeyedStore:
    """The table at path. ``key``, ``version`` and ``buckets`` count when it is new; later its own manifest says them."""

    def __init__(self, spark: SparkSession, path: str, key: str = "", version: str | None = None, buckets: int = BUCKETS, ledgers: tuple[Ledger, ...] = ()):
        self.spark, self.path, self.ledgers = spark, path.rstrip("/"), ledgers
        self.log = Log(spark, f"{self.path}/_log")
        self.fresh = {"number": -1, "key": key, "version": version, "buckets": buckets, "deltas": [], "streams": {}, "schemas": {}}

    def state(self, number: int | None = None) -> dict:
        if number is not None:
            return self.log.read(number)
        return self.log.last() or self.fresh

    @property
    def exists(self) -> bool:
        return bool(self.log.numbers())

    def _bucket(self, state: dict):
        return F.pmod(F.xxhash64(F.col(f"`{state['key']}`")), F.lit(state["buckets"])).cast("int")

    def _write(self, df: DataFrame, kind: str, state: dict) -> dict:
        """One delta; its entry. Nothing reads it before a manifest names it."""
        name = uuid.uuid4().hex
        folder = f"{self.path}/{kind}/{DELTA}={name}"
        df.write.partitionBy(BUCKET).parquet(folder)
        found = [int(n.split("=")[1]) for n in self.log.names(folder) if n.startswith(f"{BUCKET}=")]
        return {"name": name, "kind": kind, "buckets": sorted(found), "seq": None}

    @staticmethod
    def _dealt(df: DataFrame, state: dict) -> DataFrame:
        """One task for each folder, and no task with two; a window by folder and key then needs no further shuffle."""
        return df.repartitionById(state["buckets"], BUCKET)

    def _load(self, state: dict, kind: str, buckets: set[int] | None = None) -> DataFrame:
        """All rows of the deltas that a manifest names, with their folder and seq; of some folders alone, if asked."""
        schema = StructType.fromJson(state["schemas"][kind])
        entries = [e for e in state["deltas"] if e["kind"] == kind]
        paths = [f"{self.path}/{kind}/{DELTA}={e['name']}/{BUCKET}={b}" for e in entries for b in e["buckets"] if buckets is None or b in buckets]
        known = schema.add(BUCKET, IntegerType()).add(DELTA, StringType())
        if not paths:
            return self.spark.createDataFrame([], known).withColumn(SEQ, F.lit(0).cast("long")).drop(DELTA)
        rows = self.spark.read.schema(known).option("basePath", f"{self.path}/{kind}").parquet(*paths)
        seq = F.element_at(F.create_map(*(F.lit(x) for e in entries for x in (e["name"], e["seq"]))), F.col(DELTA)).cast("long")
        return rows.withColumn(SEQ, seq).drop(DELTA)

    def _merged(self, state: dict, rows: DataFrame) -> DataFrame:
        """The row of each key that counts, deletes included."""
        order = [F.col(f"`{state['version']}`").desc_nulls_last()] if state["version"] else []
        place = F.row_number().over(Window.partitionBy(BUCKET, F.col(f"`{state['key']}`")).orderBy(*order, F.col(SEQ).desc()))
        return rows.withColumn("_store_place", place).where("_store_place = 1").drop("_store_place")

    def read(self, number: int | None = None) -> DataFrame | None:
        """The table as the last manifest, or an earlier one, has it; None before the first row."""
        state = self.state(number)
        if "rows" not in state["schemas"]:
            return None
        return self._merged(state, self._load(state, "rows")).where(~F.col(DELETED)).drop(BUCKET, SEQ, DELETED)

    def read_keys(self, keys: DataFrame, state: dict | None = None) -> DataFrame:
        """The rows of some keys (one column): only their folders are read."""
        state = state or self.state()
        asked = keys.select(keys[keys.columns[0]].alias("_store_key")).distinct().withColumnRenamed("_store_key", state["key"])
        buckets = {r[0] for r in asked.select(self._bucket(state)).distinct().collect()}  # at most the number of folders
        found = self._merged(state, self._load(state, "rows", buckets)).where(~F.col(DELETED)).drop(BUCKET, SEQ, DELETED)
        return found.join(asked.withColumnRenamed(state["key"], "_store_key"), found[f"`{state['key']}`"].eqNullSafe(F.col("_store_key")), "left_semi")

    def apply(self, rows: DataFrame | None, deletes: DataFrame | None = None, stream: tuple[str, int] | None = None) -> int:
        """Publish a batch: rows to upsert, keys to delete (with a version, if the table has one). stream: (name, number) of a stream's batch, which counts once. The number of the manifest that holds it."""
        batch = None
        while True:
            state = self.state()
            if stream is not None and state["streams"].get(stream[0], -1) >= stream[1]:
                return state["number"]
            if batch is None:
                parts = [p.withColumn(DELETED, F.lit(gone)) for p, gone in ((rows, False), (deletes, True)) if p is not None]
                both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
                both = self._merged(state, self._dealt(both.withColumn(BUCKET, self._bucket(state)), state).withColumn(SEQ, F.lit(0))).drop(SEQ)
                batch = self._write(both, "rows", state)
                schema = both.drop(BUCKET).schema
            made = self._next(state, stream)
            self._grow(made, "rows", schema)
            entries = [batch | {"seq": made["number"]}] if batch["buckets"] else []
            made["deltas"] += entries
            if entries:
                for ledger in self.ledgers:
                    delta = self._ledger_delta(ledger, state, made, set(batch["buckets"]), batch["name"])
                    entry = self._write(self._dealt(delta.withColumn(BUCKET, F.pmod(F.xxhash64(*ledger.keys), F.lit(state["buckets"])).cast("int")), state), ledger.name, state)
                    self._grow(made, ledger.name, delta.schema)
                    if entry["buckets"]:
                        made["deltas"].append(entry | {"seq": made["number"]})
            try:
                self.log.publish(made)
                return made["number"]
            except Conflict:  # another batch is in the table now: ledgers are told anew against it
                continue

    @staticmethod
    def _next(state: dict, stream: tuple[str, int] | None = None) -> dict:
        made = json.loads(json.dumps(state)) | {"number": state["number"] + 1}
        if stream is not None:
            made["streams"][stream[0]] = stream[1]
        return made

    @staticmethod
    def _grow(state: dict, kind: str, schema: StructType) -> None:
        """Take new columns into the schema; all may be null."""
        known = StructType.fromJson(state["schemas"][kind]) if kind in state["schemas"] else StructType()
        have = {f.name: f.dataType for f in known}
        for f in schema:
            if f.name not in have:
                known = known.add(f.name, f.dataType, True)
            elif have[f.name].simpleString() != f.dataType.simpleString():
                raise ValueError(f"column {f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}")
        state["schemas"][kind] = known.jsonValue()

    def _ledger_delta(self, ledger: Ledger, before: dict, after: dict, buckets: set[int], name: str) -> DataFrame:
        """What the keys of a batch count now, less what they counted before."""
        only = after | {"deltas": [e for e in after["deltas"] if e["name"] == name]}
        if not any(e["kind"] == "rows" for e in before["deltas"]):
            new = self._load(only, "rows", buckets)  # nothing is replaced, and a batch has each key once
            return self._summed(ledger, ledger.make(new.where(~F.col(DELETED)).drop(BUCKET, SEQ, DELETED).withColumn("sign", F.lit(1))))
        key = F.col(f"`{after['key']}`")
        touched = self._load(only, "rows", buckets).select(key.alias("_store_key"))
        signed = None
        for state, sign in ((after, 1), (before, -1)):
            if "rows" not in state["schemas"]:
                continue
            # What was there before is read in the columns of now.
            rows = self._load(state | {"schemas": after["schemas"]}, "rows", buckets)
            rows = rows.join(touched, rows[f"`{after['key']}`"].eqNullSafe(touched["_store_key"]), "left_semi")
            part = self._merged(state, rows).where(~F.col(DELETED)).drop(BUCKET, SEQ, DELETED).withColumn("sign", F.lit(sign))
            signed = part if signed is None else signed.unionByName(part)
        return self._summed(ledger, ledger.make(signed))

    @staticmethod
    def _summed(ledger: Ledger, rows: DataFrame) -> DataFrame:
        sums = rows.groupBy(*ledger.keys).agg(*(F.sum(c).alias(c) for c in ledger.sums))
        return sums.where(" or ".join(f"`{c}` <> 0" for c in ledger.sums))

    def ledger(self, ledger: Ledger, number: int | None = None) -> DataFrame | None:
        """keys and sums over the table as it is: from the deltas of the ledger alone."""
        state = self.state(number)
        if ledger.name not in state["schemas"]:
            return None
        return self._summed(ledger, self._load(state, ledger.name).drop(BUCKET, SEQ))

    def compact(self, min_deltas: int = MIN_DELTAS) -> int:
        """Rewrite the folders that have min_deltas deltas or more, of the table and its ledgers, as one each; deletes go. The number of folders rewritten."""
        state, written = self.state(), []
        for kind in state["schemas"]:
            held: dict[int, list[dict]] = {}
            for e in state["deltas"]:
                for b in e["buckets"] if e["kind"] == kind else ():
                    held.setdefault(b, []).append(e)
            buckets = {b for b, es in held.items() if len(es) >= min_deltas}
            if not buckets:
                continue
            rows = self._load(state, kind, buckets)
            if kind == "rows":
                rows = self._merged(state, rows).where(~F.col(DELETED)).drop(SEQ)
            else:
                known = next((x for x in self.ledgers if x.name == kind), None)
                if known is None:
                    continue
                rows = rows.drop(SEQ)
                rows = rows.groupBy(BUCKET, *known.keys).agg(*(F.sum(c).alias(c) for c in known.sums)).where(" or ".join(f"`{c}` <> 0" for c in known.sums))
            entry = self._write(self._dealt(rows, state), kind, state) | {"seq": max(e["seq"] for b in buckets for e in held[b])}
            written.append((kind, buckets, entry, {e["name"] for b in buckets for e in held[b]}))
        while written:
            state = self.state()
            made = self._next(state)
            for kind, buckets, entry, names in written:
                for e in made["deltas"]:
                    if e["kind"] == kind and e["name"] in names:
                        e["buckets"] = [b for b in e["buckets"] if b not in buckets]
                made["deltas"] = [e for e in made["deltas"] if e["buckets"]] + ([entry] if entry["buckets"] else [])
            if not all(names <= {e["name"] for e in state["deltas"]} for *_, names in written):
                return 0  # another compaction was first
            try:
                self.log.publish(made)
                break
            except Conflict:
                continue
        return sum(len(b) for _, b, *_ in written)

    def vacuum(self, keep: int = 2, older_than_s: float = RETENTION_S) -> int:
        """Remove deltas that none of the last ``keep`` manifests names and that are old enough to belong to no writer at work, and the manifests before. The number of deltas removed."""
        numbers, now, gone = self.log.numbers(), time.time(), 0
        named = {e["name"] for n in numbers[-keep:] for e in self.log.read(n)["deltas"]}
        for kind in [k for k in self.log.names(self.path) if not k.startswith(("_", "."))]:
            for n in self.log.names(f"{self.path}/{kind}"):
                folder = f"{self.path}/{kind}/{n}"
                if n.startswith(f"{DELTA}=") and n.split("=")[1] not in named and now - self.log.changed(folder) >= older_than_s:
                    self.log.delete(folder)
                    gone += 1
        for n in numbers[:-keep]:
            self.log.delete(f"{self.log.folder}/{n:020d}.json")
        return gone

    def delta_bytes(self, number: int) -> int:
        """Bytes of the deltas that a manifest added."""
        return sum(self.log.length(f"{self.path}/{e['kind']}/{DELTA}={e['name']}") for e in self.log.read(number)["deltas"] if e["seq"] == number)
