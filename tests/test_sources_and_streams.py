"""Sources that users add or that fail, and streams that stop, start again and repeat batches."""

import random

import pytest
from pyspark.sql import functions as F

from lodefinder.operators import preference
from lodefinder.session import fresh_path
from lodefinder.sources import connectors, tables
from lodefinder.streaming import state


@pytest.fixture
def added():
    names = []

    def add(kind, reader):
        names.append(kind)
        connectors.register(kind, reader)

    yield add
    for n in names:
        connectors.unregister(n)


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_pruned_kind_is_not_read(spark, sf_dir):
    every = connectors.items(spark, sf_dir)
    assert "p_partkey" in scans(every) and "page_id" in scans(every)
    for one in (every.filter("kind = 'archive'"), connectors.items(spark, sf_dir, ["archive"])):
        assert "p_partkey" not in scans(one) and "page_id" in scans(one)
    assert connectors.items(spark, sf_dir, ["no such kind"]).count() == 0
    assert connectors.items(spark, sf_dir, []).count() == every.count()


def test_users_add_sources(spark, sf_dir, added):
    added("shop", lambda s, d: s.createDataFrame([("7", "A - T", 1)], "native_id string, title string, more int"))
    row = connectors.items(spark, sf_dir, ["shop"]).first()
    assert (row.kind, row.native_id, row.title, row.views) == ("shop", "7", "A - T", None)
    assert connectors.items(spark, sf_dir).filter("kind = 'shop'").count() == 1 and "shop" in connectors.kinds()


def test_a_failing_source_takes_no_other_with_it(spark, sf_dir, added):
    added("raises", lambda s, d: 1 / 0)
    added("late", lambda s, d: s.range(50).select(F.when(F.col("id") == 49, F.raise_error(F.lit("bad row"))).otherwise(F.lit("x")).alias("title")))
    added("empty", lambda s, d: s.createDataFrame([], "title string"))
    made, report = connectors.landed(spark, sf_dir)
    lines = {r.kind: r for r in report.collect()}
    assert {k for k, r in lines.items() if r.error} == {"raises", "late"} and "division" in lines["raises"].error
    assert lines["empty"].rows == 0 and lines["late"].rows == 0
    assert {r.kind: r["count"] for r in made.groupBy("kind").count().collect()} == {k: lines[k].rows for k in ("youtube", "archive")}


def test_broken_payloads_are_kept_apart(spark):
    rows = [(1, '{"a": 1, "b": "x"}'), (2, '{"a": 1'), (3, None), (4, '{"a": "no number", "b": "y"}'), (5, "")]
    got = connectors.parsed(spark.createDataFrame(rows, "id long, j string"), "j", "a long, b string").orderBy("id").collect()
    assert [(r.id, r.a, r.corrupt) for r in got] == [(1, 1, None), (2, None, rows[1][1]), (3, None, None), (4, None, rows[3][1]), (5, None, None)]
    assert got[0].j == rows[0][1] and got[0].b == "x"


def actions(spark, n, seed=5):
    rng = random.Random(seed)
    rows = [(rng.randint(0, 4), rng.randint(0, 9), rng.choice(["save", "reject", "seen", "analyze"]), rng.randint(0, 40), i) for i in range(n)]
    return spark.createDataFrame(rows, "user_id long, entity_id long, action string, t long, event_id long").withColumn("ts", F.timestamp_seconds("t"))


def statuses(df):
    return {(r.user_id, r.entity_id): r.status for r in df.collect()}


def test_statuses_survive_restarts_and_repeated_batches(spark):
    """Events in any order over several batches and two runs from one checkpoint; a batch that is written again changes nothing."""
    every = actions(spark, 300)
    root, marks = fresh_path(spark, "actions"), fresh_path(spark, "marks")
    changes, schema = state.Changes(spark, fresh_path(spark, "changes"), ["user_id", "entity_id"]), "user_id long, entity_id long, status string, batch long"

    def stream():
        return state.status_stream(spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(root))

    def land(some):
        some.coalesce(1).write.mode("append").parquet(root)

    with state.rocks(spark):
        for part in range(3):
            land(every.filter(F.col("event_id") % 5 == part))
        state.run(stream(), changes, marks)
        first = statuses(changes.read(schema))
        assert first == statuses(preference.statuses(every.filter("event_id % 5 < 3")))
        seen = max(r.batch for r in changes.spark.read.option("basePath", changes.path).parquet(changes.path).select("batch").distinct().collect())
        again = spark.createDataFrame(spark.read.parquet(f"{changes.path}/batch={seen}").collect(), "user_id long, entity_id long, status string")
        changes.write(again, seen)
        assert statuses(changes.read(schema)) == first
        land(every.filter("event_id % 5 >= 3"))
        state.run(stream(), changes, marks)
    assert statuses(changes.read(schema)) == statuses(preference.statuses(every))
    assert statuses(changes.read(schema, upto=seen)) == first  # a snapshot does not move


def test_statuses_are_folded_without_python(spark):
    """No call of Python for each track, and an action without a time is older than any other, as in the batch plan."""
    rows = [(1, 1, "reject", None, 1), (1, 1, "save", 5, 2), (1, 2, "analyze", None, 3), (2, 1, "seen", 1, 4), (None, 1, "save", 1, 5), (2, None, "save", 1, 6)]
    every = spark.createDataFrame(rows, "user_id long, entity_id long, action string, t long, event_id long").withColumn("ts", F.timestamp_seconds("t"))
    root = fresh_path(spark, "actions")
    every.coalesce(1).write.parquet(root)
    with state.rocks(spark):
        made = state.status_stream(spark.readStream.schema(every.schema).parquet(root))
        assert "InPandas" not in made._jdf.queryExecution().analyzed().toString()
        got = statuses(state.drained(made, spark, "statuses", ["user_id", "entity_id"]))
    assert got == statuses(preference.statuses(every.filter("user_id IS NOT NULL AND entity_id IS NOT NULL"))) == {(1, 1): "saved", (1, 2): "analyzed", (2, 1): "seen"}


def test_counters_survive_restarts(spark):
    every, attrs = actions(spark, 200, seed=6), spark.createDataFrame([(i, "genres", "ab"[i % 2]) for i in range(10)], "entity_id long, dim string, key string")
    root, marks = fresh_path(spark, "actions"), fresh_path(spark, "marks")
    changes, schema = state.Changes(spark, fresh_path(spark, "changes"), ["user_id", "dim", "key"]), "user_id long, dim string, key string, weight double, batch long"
    for part in (0, 1):
        every.filter(F.col("event_id") % 2 == part).coalesce(1).write.mode("append").parquet(root)
        state.run(state.weighed_stream(spark.readStream.schema(every.schema).parquet(root), attrs), changes, marks)
    want = preference.counters(every, attrs)
    assert sorted(map(tuple, changes.read(schema).select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_archive_search_keeps_the_media_type(spark):
    rows = [(str(i), "Blue Note" if i % 2 else None, ["Áb"], "audio" if i % 3 else "texts", i) for i in range(30)]
    docs = spark.createDataFrame(rows, "identifier string, title string, creator array<string>, mediatype string, pos long")
    got = [r.pos for r in connectors.archive_search(docs, F.lit("blue"), limit=5).collect()]
    assert got == [1, 5, 7, 11, 13]
    assert connectors.archive_search(docs, F.lit("ab"), media="texts").count() == 10


def test_all_ten_dimensions_are_kept(spark, sf_dir):
    dims = {r.dim for r in tables.attributes(spark, sf_dir).select("dim").distinct().collect()}
    assert dims == {*preference.READ, "feels", "textures"}
