"""Preferences in bucketed tables: no shuffle under a join, the same results as without tables, lots and restarts."""

import re

import pytest

from lodefinder.operators import preference
from lodefinder.operators.preference_store import PreferenceStore
from tests.compare import spark_rows

ACTIONS = [
    (1, 10, "save"), (1, 10, "analyze"), (1, 11, "reject"), (1, 12, "save"), (1, 13, "seen"), (1, 14, "seen"), (2, 10, "reject"),
    (2, 12, "seen"), (3, 11, "seen"), (1, 10, "save"), (None, 10, "save"), (4, None, "save"), (4, 10, "save"), (1, 12, None),
]
ATTRIBUTES = [(10, "genres", "jazz"), (10, "eras", "1970s"), (10, "feels", "warm"), (11, "genres", "funk"), (12, "genres", "jazz"), (12, "genres", "jazz"), (12, "labels", "x"), (13, "genres", "soul"), (15, "eras", "1980s")]


@pytest.fixture
def actions(spark):
    return spark.createDataFrame(ACTIONS, "user_id long, entity_id long, action string")


@pytest.fixture
def attributes(spark):
    return spark.createDataFrame(ATTRIBUTES, "entity_id long, dim string, key string")


def plain(actions, attributes):
    learned = preference.counters(actions, attributes)
    return learned, preference.affinity(actions.select("user_id", "entity_id").distinct(), attributes, learned, preference.totals(actions))


def same(store, actions, attributes):
    # a null user joins no attributes in the plain form either, but is counted there
    counters, affinity = plain(actions, attributes)
    assert spark_rows(store.counters()) == spark_rows(counters)
    assert spark_rows(store.affinity()) == spark_rows(affinity)


def test_lots_and_reopening(spark, tmp_path, actions, attributes):
    store = PreferenceStore(spark, str(tmp_path / "p"), buckets=3)
    store.describe(attributes)
    first, rest = spark.createDataFrame(ACTIONS[:6], actions.schema), spark.createDataFrame(ACTIONS[6:], actions.schema)
    store.add(first)
    store.learn()
    same(store, first, attributes)
    before = store.affinity()
    store.add(rest)
    again = PreferenceStore(spark, str(tmp_path / "p"), buckets=99)  # what the folder has decides
    assert (again.buckets, again.version) == (3, 1)
    again.learn()
    same(again, actions, attributes)
    assert spark_rows(before) == spark_rows(plain(first, attributes)[1])  # readers of the old version are not disturbed


def test_a_failed_learning_leaves_the_last_one(spark, tmp_path, actions, attributes):
    store = PreferenceStore(spark, str(tmp_path / "p"), buckets=2)
    store.describe(attributes)
    store.add(actions)
    store.learn()
    write, store._write = store._write, lambda rows, table, kind: (_ for _ in ()).throw(OSError("lost")) if kind == "signals" else write(rows, table, kind)
    with pytest.raises(OSError):
        store.learn()
    again = PreferenceStore(spark, str(tmp_path / "p"))
    assert again.version == 1
    same(again, actions, attributes)
    again.learn()  # over what the failed one has left
    same(again, actions, attributes)


def test_new_attributes_count_from_the_next_learning(spark, tmp_path, actions, attributes):
    store = PreferenceStore(spark, str(tmp_path / "p"), buckets=2)
    store.describe(attributes)
    store.add(actions)
    store.learn()
    fewer = attributes.filter("dim = 'genres'")
    store.describe(fewer)
    same(store, actions, attributes)
    store.learn()
    same(store, actions, fewer)


def test_empty_store(spark, tmp_path, actions, attributes):
    store = PreferenceStore(spark, str(tmp_path / "p"), buckets=2)
    store.describe(attributes.limit(0))
    store.add(actions.limit(0))
    store.learn()
    assert store.counters().count() == store.affinity().count() == 0
    store.add(actions)
    store.learn()
    assert {r.affinity for r in store.affinity().collect()} == {0.5}  # no attribute, no signal


def test_joins_shuffle_nothing(spark, tmp_path, actions, attributes):
    store = PreferenceStore(spark, str(tmp_path / "p"), buckets=4)
    store.describe(attributes)
    store.add(actions)
    store.learn()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        learning = store.pairs().join(spark.table(store._table("attributes", store.described)), "entity_id", "left")
        for df, shuffles in ((learning, 0), (store.affinity(), 1)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            depth = {name: [m.start() for m in re.finditer(name, plan)] for name in ("SortMergeJoin", "Exchange hashpartitioning")}
            assert len(depth["SortMergeJoin"]) == 1 and len(depth["Exchange hashpartitioning"]) == shuffles, plan
            assert all(at < depth["SortMergeJoin"][0] for at in depth["Exchange hashpartitioning"]), plan  # above the join only: of partial means
            assert "partial_avg" in plan or not shuffles
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
