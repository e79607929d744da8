"""Learning as stream state against learning in one piece."""

import datetime as dt
import random

from bizdocs.operators import dictionary as D
from bizdocs.streaming import jobs as J, learning as L

FEEDBACK = "action string, target string, dictionary_type string, field string, original_value string, suggested_value string, created_at timestamp"


def tables(spark):
    entries = spark.createDataFrame(
        [(1, "party", "Acme Ltd", "acme", None, "manual", True), (2, "item", "Bolt M8", "boltm8", "item", "manual", False), (3, "value", "Unused", "unused", None, "manual", None)],
        "entry_id long, dictionary_type string, canonical_value string, normalized_value string, field string, source string, active boolean")
    aliases = spark.createDataFrame([(1, "ACME", "acme", True), (2, "bolt 8", "bolt8", False), (3, "x", "x", None)], "entry_id long, alias_value string, normalized_alias_value string, active boolean")
    return entries, aliases


def rows(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)


def test_batches_of_any_size_learn_the_same(spark, tmp_path):
    rng = random.Random(7)
    entries, aliases = tables(spark)
    told = [(rng.choice(["accepted", "accepted", "rejected", None]), "raw_key_value", kind, rng.choice([None, "", "vendor", "buyer"]),
             rng.choice(["acme inc", "Acme Co", "bolt 8", "nut", "", None, "ACME"]), canonical, rng.choice([None, dt.datetime(2024, 1, rng.randrange(1, 28))]))
            for _ in range(60) for kind, canonical in [rng.choice([("party", "Acme Ltd"), ("item", "Bolt M8"), ("item", "Nut M8"), (None, "Other"), ("party", None)])]]
    src, out, ckpt = (str(tmp_path / p) for p in ("in", "out", "ckpt"))
    for k in range(0, 60, 20):
        spark.createDataFrame(told[k:k + 20], FEEDBACK).coalesce(1).write.mode("append").parquet(src)
        L.stream_learn(J.read_stream(spark, src, spark.createDataFrame([], FEEDBACK).schema), entries, aliases, out, ckpt).awaitTermination()
    want = D.learn(entries, aliases, spark.createDataFrame(told, FEEDBACK))
    changes = L.read_changes(spark, out)
    got = L.learned(entries, aliases, changes)
    assert rows(got[0]) == rows(want[0]) and rows(got[1]) == rows(want[1])
    state = L.read_state(spark, ckpt)
    assert rows(state) == rows(want[0].select(state.columns))
    assert changes.filter("canonical_value = 'Unused'").isEmpty()  # only what changed is written
    before = changes.count()
    spark.createDataFrame(told, FEEDBACK).coalesce(1).write.mode("append").parquet(src)  # everything delivered again
    L.stream_learn(J.read_stream(spark, src, spark.createDataFrame([], FEEDBACK).schema), entries, aliases, out, ckpt).awaitTermination()
    assert L.read_changes(spark, out).count() == before


def test_nothing_known_before(spark, tmp_path):
    entries, aliases = (df.limit(0) for df in tables(spark))
    src, out, ckpt = (str(tmp_path / p) for p in ("in", "out", "ckpt"))
    spark.createDataFrame([("accepted", "t", "item", None, "nut", "Nut M8", None)], FEEDBACK).coalesce(1).write.parquet(src)
    L.stream_learn(J.read_stream(spark, src, spark.createDataFrame([], FEEDBACK).schema), entries, aliases, out, ckpt).awaitTermination()
    e, a = L.learned(entries, aliases, L.read_changes(spark, out))
    assert [r["canonical_value"] for r in e.collect()] == ["Nut M8"] and [r["alias_value"] for r in a.collect()] == ["nut"]
