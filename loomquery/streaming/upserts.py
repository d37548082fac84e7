"""Incremental upsert and key rotation."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import KeyedStore, Ledger, Log


def upsert_stream(rows: DataFrame, table_path: str, checkpoint: str, key: str, version: str, ledgers: tuple[Ledger, ...] = ()) -> StreamingQuery:
    """Each micro-batch is one delta of the ``KeyedStore`` at table_path: the last version of each key counts, and what a batch writes follows its own size.

    The manifest names the stream (its checkpoint) and the batch, so a batch that runs again after a failure changes nothing; a stream with a new checkpoint goes on from the table as it is.
    """
    run = hashlib.md5(checkpoint.encode()).hexdigest()

    def apply(batch: DataFrame, batch_id: int) -> None:
        KeyedStore(batch.sparkSession, table_path, key, version, ledgers=ledgers).apply(batch, stream=(run, batch_id))

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def generations(spark: SparkSession, table_path: str) -> list[tuple[int, str]]:
    """(number, name) of the states of a table: manifests of a store, or complete folders generation=number."""
    log = Log(spark, f"{table_path}/_log")
    known = log.numbers()
    if known:
        return [(n, f"{n:020d}") for n in known]
    whole = [n for n in log.names(table_path) if n.startswith("generation=") and log.names(f"{table_path}/{n}").count("_SUCCESS")]
    return [(int(n.removeprefix("generation=").split("-")[0]), n) for n in whole]


def current(spark: SparkSession, table_path: str) -> DataFrame | None:
    """The table's last state; None if there is none."""
    held = KeyedStore(spark, table_path)
    if held.exists:
        return held.read()
    known = generations(spark, table_path)
    return spark.read.parquet(f"{table_path}/{max(known)[1]}") if known else None


def rotations(calls: DataFrame, n_keys: int) -> DataFrame:
    """client, n_calls, n_rotations, n_cooldowns, current_key, n_limited for a log (client, seq, limited) of calls.

    A limited call burns the current key and moves to the next unburned one, wrapping around; when all are burned a cooldown frees all and the first is next.
    Calls stream through a task in order of client and seq, sorted by Spark: memory holds one client's set of burned keys, however long its log.
    """
    if n_keys < 1:
        raise ValueError("n_keys must be positive")

    def run(frames):
        current, state, out = None, None, []

        def rows():
            return pd.DataFrame(out, columns=["client", "n_calls", "n_rotations", "n_cooldowns", "current_key", "n_limited"])

        for frame in frames:
            for client, limited in zip(frame["client"], frame["limited"], strict=True):
                if state is None or client != current:
                    if state is not None:
                        out.append((current, *state[:5]))
                    current, state = client, [0, 0, 0, 0, 0, set()]
                state[0] += 1
                if not limited:
                    continue
                state[4] += 1
                state[5].add(state[3])
                ahead = next((k for k in ((state[3] + i) % n_keys for i in range(1, n_keys + 1)) if k not in state[5]), None)
                if ahead is None:
                    state[2], state[3] = state[2] + 1, 0
                    state[5].clear()
                else:
                    state[1], state[3] = state[1] + 1, ahead
            if len(out) >= 10_000:
                yield rows()
                out = []
        if state is not None:
            out.append((current, *state[:5]))
        yield rows()

    ordered = calls.select("client", "seq", F.coalesce("limited", F.lit(False)).alias("limited")).where("client is not null").repartition("client").sortWithinPartitions("client", "seq")
    return ordered.mapInPandas(run, f"client {ordered.schema['client'].dataType.simpleString()}, n_calls long, n_rotations int, n_cooldowns int, current_key int, n_limited long")


def key_calls(calls: DataFrame) -> DataFrame:
    """client, key, n_calls, n_limited of a log of calls (client, key, limited): the statistics of each key."""
    return calls.groupBy("client", "key").agg(F.count("*").alias("n_calls"), F.count_if(F.coalesce("limited", F.lit(False))).alias("n_limited"))
