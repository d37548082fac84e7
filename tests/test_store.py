"""The keyed store: merges, ledgers, crashes, conflicts, streams, compaction."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomquery.operators import retrieval
from loomquery.sources import collection, store
from loomquery.sources.store import KeyedStore

ROW = "chunk_id string, text string, v int"


def held(s):
    df = s.read()
    return {} if df is None else {r.chunk_id: (r.text, r.v) for r in df.collect()}


def terms(s):
    return {r.term: (r.df, r.cf) for r in collection.term_statistics(s).collect()}


def test_any_series_of_batches_equals_one_table(spark, tmp_path):
    rng, model = random.Random(1), {}
    s = KeyedStore(spark, str(tmp_path / "t"), "chunk_id", "v", buckets=4, ledgers=(collection.TERMS,))
    assert s.read() is None and not s.exists
    word = lambda: rng.choice(["a", "b", "C", "d", "ä"])
    for n in range(6):
        rows = {k: (" ".join(word() for _ in range(rng.randrange(5))) if rng.random() < 0.9 else None, rng.randrange(n, n + 3)) for k in rng.sample([None, *"klmnopqr"], 4)}
        gone = {k: rng.randrange(n, n + 3) for k in rng.sample("klmnopqr", 2) if k not in rows} if n % 2 else {}
        deletes = spark.createDataFrame(list(gone.items()), "chunk_id string, v int") if gone else None
        assert s.apply(spark.createDataFrame([(k, *r) for k, r in rows.items()], ROW), deletes) == n
        for k, (text, v) in [*rows.items(), *((k, (None, v)) for k, v in gone.items())]:
            if k not in model or v >= model[k][1]:
                model[k] = (text, v, k in gone)
        want = {k: (t, v) for k, (t, v, dead) in model.items() if not dead}
        assert held(s) == want
        scratch = spark.createDataFrame([(k, t) for k, (t, _) in want.items()], "chunk_id string, text string")
        assert terms(s) == {r.term: (r.df, r.cf) for r in retrieval.term_counts(scratch).collect()}
        assert collection.sizes(s) == (len(want), sum(len((t or "").split()) for t, _ in want.values()))
        if n == 3:
            before = terms(s)
            assert s.compact(min_deltas=2) > 0 and held(s) == want and terms(s) == before
            assert s.vacuum(keep=1, older_than_s=0) > 0 and held(s) == want and terms(s) == before
            s.log.publish(s._next(s.state()))  # numbers go on after a compaction
            model_number = s.state()["number"]
            s = KeyedStore(spark, str(tmp_path / "t"), ledgers=(collection.TERMS,))
            assert model_number == 5
            break
    asked = spark.createDataFrame([("k",), (None,), ("zz",)], "x string")
    assert {r.chunk_id for r in s.read_keys(asked).collect()} == {"k", None} & set(held(s))


def test_a_crash_at_each_step_loses_nothing(spark, tmp_path, monkeypatch):
    s = KeyedStore(spark, str(tmp_path / "t"), "chunk_id", "v", buckets=2, ledgers=(collection.TERMS,))
    row = lambda *r: spark.createDataFrame(r, ROW)
    s.apply(row(("a", "one two", 1), ("b", "two", 1)))
    before, counts = held(s), terms(s)

    class Crash(Exception):
        pass

    def crash(*_):
        raise Crash

    publish, write = store.Log.publish, KeyedStore._write
    for step in ("before the rows", "after the rows", "before the ledger", "before the manifest", "in the middle of the manifest"):
        with monkeypatch.context() as m:
            if step == "before the rows":
                m.setattr(KeyedStore, "_write", crash)
            elif step == "after the rows":
                m.setattr(KeyedStore, "_write", lambda self, *a: (write(self, *a), crash()))
            elif step == "before the ledger":
                m.setattr(KeyedStore, "_ledger_delta", crash)
            elif step == "before the manifest":
                m.setattr(store.Log, "publish", crash)
            else:
                m.setattr(store.Log, "publish", lambda self, made: ((tmp_path / "t/_log/.half.tmp").write_text('{"num'), crash()))
            with pytest.raises(Crash):
                s.apply(row(("a", "three", 2)))
        assert held(s) == before and terms(s) == counts, step
    with monkeypatch.context() as m:
        m.setattr(store.Log, "publish", lambda self, made: (publish(self, made), crash()))
        with pytest.raises(Crash):
            s.apply(row(("a", "three", 2)), stream=("s", 0))
    assert held(s) == {"a": ("three", 2), "b": ("two", 1)}
    assert s.apply(row(("a", "again", 9)), stream=("s", 0)) == 1 and held(s)["a"] == ("three", 2)
    with monkeypatch.context() as m:
        m.setattr(store.Log, "publish", crash)
        with pytest.raises(Crash):
            s.compact(min_deltas=1)
    assert held(s) == {"a": ("three", 2), "b": ("two", 1)} and s.vacuum(older_than_s=0) >= 4 and held(s)["a"] == ("three", 2)
    assert terms(s) == {"three": (1, 1), "two": (1, 1)}


def test_writers_that_meet(spark, tmp_path, monkeypatch):
    """A batch that another overtakes between its read and its manifest is published after it, with sums over both."""
    path = str(tmp_path / "t")
    mine, other = (KeyedStore(spark, path, "chunk_id", "v", 2, (collection.TERMS,)) for _ in range(2))
    row = lambda *r: spark.createDataFrame(r, ROW)
    mine.apply(row(("a", "x", 1)))
    publish, once = store.Log.publish, []

    def overtaken(self, made):
        if not once:
            once.append(1)
            other.apply(row(("a", "y y", 2), ("b", "z", 2)))
        publish(self, made)

    monkeypatch.setattr(store.Log, "publish", overtaken)
    assert mine.apply(row(("a", "w", 3))) == 2
    assert held(mine) == {"a": ("w", 3), "b": ("z", 2)} and terms(mine) == {"w": (1, 1), "z": (1, 1)}
    with pytest.raises(ValueError, match="column v is int"):
        mine.apply(spark.createDataFrame([("q", "t", "no")], "chunk_id string, text string, v string"))


def test_a_batch_writes_in_proportion_to_itself(spark, tmp_path):
    s = KeyedStore(spark, str(tmp_path / "t"), "id", buckets=8)
    many = spark.range(60_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
    first = s.delta_bytes(s.apply(many))
    second = s.delta_bytes(s.apply(many.where("id % 3000 = 7").withColumn("more", F.lit(1))))
    assert second < first / 50 and s.read().count() == 60_000 and s.read().where("more = 1").count() == 20 and s.read(0).where("id = 7").columns == ["id", "text"]
    assert s.apply(many.where("false")) == 2 and s.delta_bytes(2) == 0
    one = s.read_keys(spark.createDataFrame([(7,)], "id long"))
    assert one.first().more == 1 and len({f.split("_store_bucket=")[1][0] for f in one.inputFiles() if "_store_bucket=" in f}) == 1


def test_a_task_writes_one_folder(spark, tmp_path):
    """No task of a delta has the rows of two folders, of the table or of its ledger."""
    s = store.KeyedStore(spark, f"file://{tmp_path}/t", "chunk_id", "v", ledgers=(collection.TERMS,))
    s.apply(spark.createDataFrame([(i, f"w{i} w{i % 7}", 1) for i in range(400)], "chunk_id long, text string, v int"))
    for kind in ("rows", "terms"):
        files = [f.name for f in (tmp_path / "t" / kind).rglob("part-*.parquet")]
        assert len(files) == store.BUCKETS and len({f.split("-")[1] for f in files}) == len(files)


def test_terms_are_counted_by_sign(spark):
    rng = random.Random(3)
    texts = [(rng.choice((1, 1, -1)), rng.choice((None, "", " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 90)))))) for _ in range(300)]
    got = retrieval.counted_terms(spark.createDataFrame(texts, "sign int, text string").repartition(3)).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    df, cf = Counter(), Counter()
    for sign, text in texts:
        words = (text or "").split()
        df[""] += sign
        cf[""] += sign * len(words)
        for w, n in Counter(words).items():
            df[w] += sign
            cf[w] += sign * n
    assert {r.term: (r.df, r.cf) for r in got.collect()} == {t: (df[t], cf[t]) for t in df}
