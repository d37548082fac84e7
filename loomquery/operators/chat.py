"""Conversations as an append-only log of changes, and the latest state as a view.

Spark has no row updates, so every change is a row (seq, op, user_id, conv_id, ...): create, rename, delete, add. What an owner may see is a
query over the log. A change by another than the conversation's owner has no effect; a conversation without an owner is nobody's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

LOG_SCHEMA = "seq long, op string, user_id string, conv_id long, title string, role string, content string, payload string, at timestamp"
ROLES = ("user", "assistant")


def valid_user_id(user_id: Column) -> Column:
    return F.coalesce(user_id.rlike("^[0-9a-f]{32}$"), F.lit(False))


def effective(log: DataFrame) -> DataFrame:
    """The changes that count: of the owner, from the creation on and up to a deletion, messages in a known role."""
    made = log.where("op = 'create' and user_id is not null").groupBy("conv_id").agg(F.min_by("user_id", "seq").alias("owner"), F.min("seq").alias("made"))
    own = log.join(made, "conv_id").where((F.col("user_id") == F.col("owner")) & (F.col("seq") >= F.col("made")))
    gone = own.where("op = 'delete'").groupBy("conv_id").agg(F.min("seq").alias("gone"))
    alive = own.join(gone, "conv_id", "left_anti")
    return alive.where((F.col("op") != "add") | F.col("role").isin(*ROLES)).drop("owner", "made")


def refused(log: DataFrame) -> DataFrame:
    """seq, reason of the changes that had no effect: not_owner (also for one that doesn't exist) or bad_role."""
    made = log.where("op = 'create' and user_id is not null").groupBy("conv_id").agg(F.min_by("user_id", "seq").alias("owner"), F.min("seq").alias("made"))
    gone = log.join(made, "conv_id").where("op = 'delete' and user_id = owner and seq > made").groupBy("conv_id").agg(F.min("seq").alias("gone"))
    rows = log.where("op <> 'create'").join(made, "conv_id", "left").join(gone, "conv_id", "left")
    ok = F.coalesce((F.col("user_id") == F.col("owner")) & (F.col("seq") > F.col("made")) & (F.col("gone").isNull() | (F.col("seq") <= F.col("gone"))), F.lit(False))
    reason = F.when((F.col("op") == "add") & ~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)), "bad_role").when(~ok, "not_owner")
    return rows.select("seq", reason.alias("reason")).where("reason is not null")


def conversations(log: DataFrame) -> DataFrame:
    """user_id, conv_id, title, created_at, updated_at, n_messages, rank: each owner's, the last changed first."""
    rows = effective(log)
    state = rows.groupBy("user_id", "conv_id").agg(
        F.max_by("title", F.when(F.col("op").isin("create", "rename"), F.col("seq"))).alias("title"),
        F.min("at").alias("created_at"), F.max("at").alias("updated_at"), F.count_if(F.col("op") == "add").alias("n_messages"),
    )
    order = Window.partitionBy("user_id").orderBy(F.col("updated_at").desc(), F.col("conv_id").desc())
    return state.withColumn("title", F.coalesce("title", F.lit("New chat"))).withColumn("rank", F.row_number().over(order))


def messages(log: DataFrame) -> DataFrame:
    """user_id, conv_id, pos, role, content, payload of living conversations; a payload that isn't JSON is null."""
    rows = effective(log).where("op = 'add'")
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("at", "seq"))
    return rows.select("user_id", "conv_id", pos.alias("pos"), "role", "content", F.when(F.try_parse_json("payload").isNotNull(), F.col("payload")).alias("payload"))


def user_id_or_new(user_id: Column) -> Column:
    """A valid user id as it is, for any other a new one: 32 hexadecimal digits."""
    return F.when(valid_user_id(user_id), user_id).otherwise(F.replace(F.uuid(), F.lit("-"), F.lit("")))


def migrated(legacy: DataFrame) -> DataFrame:
    """Changes of the log for conversations (conv_id, title, created_at) from before there were owners: made, but nobody's, so no view shows them."""
    null = lambda kind: F.lit(None).cast(kind)
    return legacy.select(
        F.col("conv_id").alias("seq"), F.lit("create").alias("op"), null("string").alias("user_id"), "conv_id", "title", null("string").alias("role"), null("string").alias("content"),
        null("string").alias("payload"), F.col("created_at").cast("timestamp").alias("at"),
    )


def change(op: str, user_id: str, conv_id: int, at, seq: int, title: str | None = None, role: str | None = None, content: str | None = None, payload: str | None = None) -> tuple:
    """One row of the log. A message in an unknown role is an error; who may change what, ``refused`` tells."""
    if op not in ("create", "rename", "delete", "add"):
        raise ValueError(f"unknown change {op!r}")
    if op == "add" and role not in ROLES:
        raise ValueError(f"unknown role {role!r}")
    return seq, op, user_id, conv_id, title, role, content, payload, at


def conversation(log: DataFrame, user_id: str, conv_id: int) -> DataFrame:
    """One conversation of an owner; no row for another's, a deleted one, or one that doesn't exist."""
    return conversations(log).where((F.col("user_id") == user_id) & (F.col("conv_id") == conv_id))
