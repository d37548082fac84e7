"""Conversations and messages as tables that follow the log of changes, batch by batch.

``operators.chat`` replays a whole log for each look at it. Here a batch of changes is judged against the heads of its own conversations, of which only the folders of these are read, and adds its
messages and their new heads to two keyed stores. Views are reads of those.

Changes come in the order of seq within a conversation, over batches too; a batch that runs again changes nothing. Messages are published before heads, and a message shows only under a living
head, so a crash between the two shows the state before the batch or after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import chat
from ..sources.shared import stored
from ..sources.store import KeyedStore

HEAD = "conv_id long, user_id string, made long, title string, title_seq long, created_at timestamp, updated_at timestamp, n_messages long, gone boolean"


class ChatView:
    """The state at path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.heads = KeyedStore(spark, f"{path}/heads", "conv_id")
        self.said = KeyedStore(spark, f"{path}/messages", "seq")

    def apply(self, changes: DataFrame, stream: tuple[str, int]) -> None:
        """Take in a batch (chat.LOG_SCHEMA) of the stream of this name."""
        batch = stored(changes, "chat_batch")
        touched = batch.select("conv_id").distinct()
        prior = self.heads.read_keys(touched) if self.heads.exists else self.spark.createDataFrame([], HEAD)
        prior = stored(prior, "chat_heads")
        # What is known of a conversation stands as its creation; one that is gone stays so.
        known = prior.where("not gone").select(F.col("made").alias("seq"), F.lit("create").alias("op"), "user_id", "conv_id", "title", *(F.lit(None).cast("string").alias(c) for c in ("role", "content", "payload")), F.col("created_at").alias("at"))
        columns = known.columns
        open_batch = batch.select(*columns).join(prior.where("gone").select("conv_id"), "conv_id", "left_anti")
        both = known.unionByName(open_batch)
        counted = stored(chat.effective(both).join(known.select("seq", "conv_id"), ["seq", "conv_id"], "left_anti").select(*columns), "chat_effective")
        self.said.apply(counted.where("op = 'add'").select("seq", "conv_id", "user_id", "role", "content", "payload", "at"), stream=stream)
        new = counted.groupBy("conv_id").agg(
            F.min("user_id").alias("user_id"), F.min("seq").alias("made"), F.max_by("title", F.when(F.col("op").isin("create", "rename"), F.col("seq"))).alias("title"), F.max(F.when(F.col("op").isin("create", "rename"), F.col("seq"))).alias("title_seq"),
            F.min("at").alias("created_at"), F.max("at").alias("updated_at"), F.count_if(F.col("op") == "add").alias("n_messages"), F.lit(False).alias("gone"),
        )
        alive = prior.where("not gone")
        ended = both.join(both.where("op = 'create' and user_id is not null").groupBy("conv_id").agg(F.min_by("user_id", "seq").alias("owner"), F.min("seq").alias("first")), "conv_id").where("op = 'delete' and user_id = owner and seq >= first").select("conv_id").distinct()
        ended = ended.select("conv_id", *(F.lit(None).cast(t).alias(c) for c, t in (("user_id", "string"), ("made", "long"), ("title", "string"), ("title_seq", "long"), ("created_at", "timestamp"), ("updated_at", "timestamp"))), F.lit(0).cast("long").alias("n_messages"), F.lit(True).alias("gone"))
        merged = alive.join(new.select("conv_id"), "conv_id", "left_semi").unionByName(new).groupBy("conv_id").agg(
            F.min("user_id").alias("user_id"), F.min("made").alias("made"), F.max_by("title", "title_seq").alias("title"), F.max("title_seq").alias("title_seq"),
            F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"), F.sum("n_messages").alias("n_messages"), F.lit(False).alias("gone"),
        )
        self.heads.apply(merged.join(ended, "conv_id", "left_anti").unionByName(ended), stream=stream)

    def follow(self, log: DataFrame, checkpoint: str) -> StreamingQuery:
        """A stream of changes into the view; the checkpoint names it."""
        return log.writeStream.foreachBatch(lambda batch, n: self.apply(batch, (checkpoint, n))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def conversations(self) -> DataFrame:
        """chat.conversations of the log so far."""
        order = Window.partitionBy("user_id").orderBy(F.col("updated_at").desc(), F.col("conv_id").desc())
        living = self.heads.read().where("not gone")
        return living.select("user_id", "conv_id", F.coalesce("title", F.lit("New chat")).alias("title"), "created_at", "updated_at", "n_messages").withColumn("rank", F.row_number().over(order))

    def messages(self) -> DataFrame:
        """chat.messages of the log so far."""
        rows = self.said.read().join(self.heads.read().where("not gone").select("conv_id"), "conv_id", "left_semi")
        pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("at", "seq"))
        return rows.select("user_id", "conv_id", pos.alias("pos"), "role", "content", F.when(F.try_parse_json("payload").isNotNull(), F.col("payload")).alias("payload"))
