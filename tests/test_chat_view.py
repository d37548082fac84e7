"""The maintained view of the chat against a replay of the log, after each batch."""

import datetime as dt
import random
from collections import Counter

import pytest

from loomquery.operators import chat
from loomquery.sources import store
from loomquery.streaming.chat_view import ChatView


def test_view_equals_replay_after_each_batch(spark, tmp_path, monkeypatch):
    rng, log, seq = random.Random(6), [], 0
    view = ChatView(spark, str(tmp_path / "view"))
    at = dt.datetime(2026, 1, 1)
    for n in range(4):
        batch = []
        for _ in range(40):
            seq += 1
            conv, user = rng.randrange(8), rng.choice(["a", "b", None])
            op = rng.choices(["create", "add", "rename", "delete"], [3, 8, 2, 1 if n else 0])[0]
            batch.append((seq, op, user, conv, rng.choice([None, f"t{seq}"]) if op in ("create", "rename") else None, rng.choice(["user", "assistant", "system"]) if op == "add" else None, f"m{seq}", rng.choice([None, "{", '{"a": 1}']), at + dt.timedelta(minutes=seq // 3)))
        log += batch
        df = spark.createDataFrame(batch, chat.LOG_SCHEMA)
        if n == 2:
            publish, calls = store.Log.publish, []

            def second(self, made):
                calls.append(1)
                if len(calls) == 2:
                    raise RuntimeError("crash between messages and heads")
                publish(self, made)

            with monkeypatch.context() as m:
                m.setattr(store.Log, "publish", second)
                with pytest.raises(RuntimeError):
                    view.apply(df, ("s", n))
        view.apply(df, ("s", n))
        view.apply(df, ("s", n))
        whole = spark.createDataFrame(log, chat.LOG_SCHEMA)
        assert Counter(map(tuple, view.conversations().collect())) == Counter(map(tuple, chat.conversations(whole).collect())), n
        assert Counter(map(tuple, view.messages().collect())) == Counter(map(tuple, chat.messages(whole).collect())), n


def test_users_see_their_own(spark, tmp_path):
    """Two users; one owns two conversations, the other one; a stream of two files."""
    t = dt.datetime(2026, 1, 1)
    rows = [chat.change("create", "A", 1, t, 1, "one"), chat.change("create", "A", 2, t, 2, "two"), chat.change("create", "B", 3, t, 3, "three"), chat.change("add", "A", 1, t, 4, role="user", content="mine"), chat.change("add", "B", 3, t, 5, role="user", content="yours"), chat.change("add", "B", 1, t, 6, role="user", content="intruder"), chat.change("delete", "B", 2, t, 7)]
    source = str(tmp_path / "in")
    view = ChatView(spark, str(tmp_path / "view"))
    for part in (rows[:4], rows[4:]):
        spark.createDataFrame(part, chat.LOG_SCHEMA).coalesce(1).write.mode("append").parquet(source)
        view.follow(spark.readStream.schema(chat.LOG_SCHEMA).parquet(source), str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.user_id, r.conv_id, r.n_messages) for r in view.conversations().collect()) == [("A", 1, 1), ("A", 2, 0), ("B", 3, 1)]
    assert sorted((r.user_id, r.content) for r in view.messages().collect()) == [("A", "mine"), ("B", "yours")]
