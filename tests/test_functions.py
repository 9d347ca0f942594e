"""Golden rows and properties of the column functions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodefinder.functions import text, values, vocab
from lodefinder.operators import audio, linkage, preference, scoring
from lodefinder.operators.scoring import SearchQuery


def one(spark, make, *args):
    names = [f"c{i}" for i in range(len(args))]
    df = spark.createDataFrame([args], ", ".join(f"{n} {'double' if isinstance(a, float) else 'long' if isinstance(a, int) else 'string'}" for n, a in zip(names, args)))
    return df.select(make(*(F.col(n) for n in names)).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "artist", "title", "year"),
    [
        ("T. Yamashita ~ Sparkle (1982) [Vinyl Rip] HQ", None, "T. Yamashita Sparkle", 1982),
        ("Tatsuro Yamashita – Sparkle (1982)", "Tatsuro Yamashita", "Sparkle", 1982),
        ("A - B - C (Official Audio)", "A", "B - C", None),
        ("[HQ]", None, "", None),
        ("Rare Groove LP - Vinyl Rip", None, "Groove -", None),
        ("", None, "", None),
    ],
)
def test_titles(spark, raw, artist, title, year):
    split = one(spark, lambda c: F.struct(*(x.alias(n) for x, n in zip(text.artist_and_title(c), "at")), text.year_of(c).alias("y")), raw)
    assert (split.a, split.t, split.y) == (artist, title, year)


@pytest.mark.parametrize(
    ("raw", "key"),
    [("Am groove", "A minor"), ("F# minor", "F# minor"), ("Bb maj", "Bb major"), ("A Minor x", None), ("Em7", None), ("key of dreams", "d"), ("A major label deal", "A major"), (None, None)],
)
def test_keys(spark, raw, key):
    assert one(spark, text.key_of, raw) == key


@pytest.mark.parametrize(("raw", "bpm"), [("92 BPM", 92.0), ("92bpm x", 92.0), ("92.5 bpm", None), ("1 bpm", None), ("x92 bpm", None)])
def test_bpm(spark, raw, bpm):
    assert one(spark, text.bpm_of, raw) == bpm


@pytest.mark.parametrize(("iso", "seconds"), [("PT3M25S", 205), ("PT", 0), ("P1DT2H", None), ("PT1H", 3600), (None, None)])
def test_durations(spark, iso, seconds):
    assert one(spark, values.duration_seconds, iso) == seconds


@pytest.mark.parametrize(("role", "instrument"), [("Bass Guitar", "guitar"), ("Bassoon", "bass"), ("Electric Piano", "Rhodes"), ("Harp", None)])
def test_roles(spark, role, instrument):
    assert one(spark, text.role_instrument, role) == instrument


def test_similarity(spark):
    assert one(spark, text.similarity, "", "") == 1.0
    assert one(spark, text.similarity, "Café", "cafe") == 1.0
    assert one(spark, text.similarity, "abc", "xyz") == 0.0


def test_similarity_is_symmetric(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choices("abé C!", k=rng.randint(0, 9))), "".join(rng.choices("abé C!", k=rng.randint(0, 9)))) for _ in range(200)]
    df = spark.createDataFrame(rows, "a string, b string").select(text.similarity(F.col("a"), F.col("b")).alias("x"), text.similarity(F.col("b"), F.col("a")).alias("y"))
    assert all(r.x == r.y and 0 <= r.x <= 1 for r in df.collect())


def test_slug_list_range(spark):
    assert one(spark, text.slug, "  Hello, Wörld! ") == "hello-w-rld"
    assert one(spark, values.list_of, " a, ,b ,") == ["a", "b"]
    assert one(spark, values.list_of, " , ") is None
    r = one(spark, values.range_of, "", "120")
    assert (r.lo, r.hi) == (0.0, 120.0)
    assert one(spark, values.range_of, "", " ") is None


@pytest.mark.parametrize(("low", "high", "want"), [("NaN", "", (0.0, 9999.0)), ("80d", "90f", (0.0, 9999.0)), (" 1e2 ", "Infinity", (100.0, 9999.0)), ("-5.5", ".5", (-5.5, 0.5)), ("0", "0", (0.0, 9999.0))])
def test_ranges_take_decimal_numbers_only(spark, low, high, want):
    assert tuple(one(spark, values.range_of, low, high)) == want


def test_relayed(spark):
    assert one(spark, values.relayed, "text/html", None) == '{"raw":null}'
    assert one(spark, values.relayed, "text/html", "<a>") == '{"raw":"<a>"}'
    assert one(spark, values.relayed, "application/json", '{"a": 1}') == '{"a": 1}'
    assert one(spark, values.relayed, "application/json", "{a") is None and one(spark, values.relayed, "application/json", None) is None


def test_hours_without_events_count(spark):
    df = spark.createDataFrame([("a", h, 1.0) for h in (0, 3, 6, 9, 12)] + [("b", 5, 2.0)], "g string, h int, n double").withColumn("h", F.timestamp_seconds(F.col("h") * 3600))
    filled = audio.gapless(df, "g", "h", "n", "1 hour")
    assert filled.filter("g = 'a'").count() == 13
    assert {r.g: r.confidence for r in audio.periodicities(filled, "g", "h", "n").collect()} == {"a": 0.9, "b": 0.8}


def test_hosts(spark):
    assert one(spark, lambda c: values.host_allowed(values.host_of(c)), "https://API.discogs.com/x") is True
    assert one(spark, lambda c: values.host_allowed(values.host_of(c)), "https://evil-archive.org/x") is False
    assert one(spark, lambda c: values.host_allowed(values.host_of(c)), None) is False


def tracks(spark, **changes):
    row = {"want": None, "have": None, "video_views": None, "age_days": None, "year": None, "label": None, "n_credits": 0, "confirmed": False, "duration_sec": None} | changes
    df = spark.createDataFrame([tuple(row.values())], "want long, have long, video_views long, age_days long, year int, label string, n_credits int, confirmed boolean, duration_sec long")
    empty = F.array().cast("array<string>")
    return df.withColumns({"genres": empty, "styles": empty, "bpm": F.lit(None).cast("struct<value:double>"), "key": F.lit(None).cast("struct<value:string>"), "instruments": F.lit(None).cast("struct<value:array<string>>")})


@pytest.mark.parametrize(
    ("changes", "component", "value"),
    [
        ({"want": 1000, "have": 10}, "rarity", 1.0),
        ({"want": 23, "have": 1240}, "rarity", 0.00399),
        ({}, "rarity", 0.3),
        ({"want": 15, "have": 0}, "rarity", 0.60206),
        ({"video_views": 300}, "obscurity", 0.58715),
        ({"video_views": 1_000_000}, "obscurity", 0.0),
        ({"video_views": 300, "age_days": 0}, "obscurity", 0.29357),
        ({}, "obscurity", 0.4),
        ({"duration_sec": 29}, "source_quality", 0.25),
        ({"duration_sec": 30}, "source_quality", 0.45),
        ({"duration_sec": 1801, "confirmed": True}, "source_quality", 0.4),
        ({"year": 1967}, "history", 0.5),
        ({"year": 1968}, "history", 0.9),
        ({"year": 1986}, "history", 0.9),
        ({"year": 0}, "history", 0.4),
        ({"year": 1970, "label": "x", "confirmed": True}, "richness", 0.6),
        ({}, "filter_match", 0.6),
    ],
)
def test_components(spark, changes, component, value):
    assert scoring.components(tracks(spark, **changes), SearchQuery()).first()[component] == pytest.approx(value, abs=1e-5)


def test_reasons(spark):
    rich = scoring.scored(tracks(spark, want=1000, have=10, video_views=300, year=1970), SearchQuery()).first()
    assert rich.reasons == ["1000 want it, 10 have it", "only 300 views", "from 1968-1979"]
    assert scoring.scored(tracks(spark, want=23, have=1240), SearchQuery()).first().reasons == []
    # missing year is a miss, missing bpm and key are no check
    assert scoring.components(tracks(spark), SearchQuery(year=(1970, 1980), bpm=(80, 90), key="A")).first().filter_match == 0.0


def test_key_estimate(spark):
    rng = np.random.default_rng(5)
    profiles = [[1.0] * 12, vocab.MAJOR, np.roll(vocab.MINOR, 9).tolist(), *rng.random((20, 12)).tolist()]
    got = [tuple(r) for r in spark.createDataFrame([(i, p) for i, p in enumerate(profiles)], "i long, p array<double>").orderBy("i").select(audio.key_estimate(F.col("p")).alias("k")).select("k.*").collect()]
    assert got[:3] == [("C major", 0.0), ("C major", 1.0), ("A minor", 1.0)]
    for p, (key, _) in zip(profiles[3:], got[3:]):
        r = [np.corrcoef(np.roll(p, -i), t)[0, 1] for i in range(12) for t in (vocab.MAJOR, vocab.MINOR)]
        assert audio.KEYS[int(np.argmax(r))] == key


def test_a_key_reads_its_frames_once(spark):
    """Expressions that are named twice are computed twice, and within others a thousand times: each is bound."""
    frames = [np.random.default_rng(6).random((3, 12)).tolist(), [[0.0] * 12], None]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(frames)], "i long, heard array<array<double>>")
    found = df.select("i", audio.key_estimate(audio.chroma_profile(F.col("heard"))).alias("k"))
    assert found._jdf.queryExecution().analyzed().toString().splitlines()[0].count("heard") == 1
    got = {r.i: r.k for r in found.collect()}
    mean = np.mean(frames[0], axis=0)
    r = [np.corrcoef(np.roll(mean, -i), t)[0, 1] for i in range(12) for t in (vocab.MAJOR, vocab.MINOR)]
    assert tuple(got[0]) == (audio.KEYS[int(np.argmax(r))], round((max(r) + 1) / 2, 2)) and tuple(got[1]) == ("C major", 0.0) and tuple(got[2]) == ("C major", 1.0)


def actions(spark, rows):
    return spark.createDataFrame(rows, "user_id long, entity_id long, action string, ts long, event_id long")


def test_status_is_a_fold(spark):
    rng = random.Random(9)
    rows = [(rng.randint(0, 3), rng.randint(0, 5), rng.choice(["save", "reject", "seen", "analyze"]), rng.randint(0, 20), i) for i in range(400)]
    state = {}
    for user, entity, action, *_ in sorted(rows, key=lambda r: (r[3], r[4])):
        now = state.get((user, entity))
        state[user, entity] = {"save": "saved", "reject": "rejected", "seen": now or "seen", "analyze": "saved" if now == "saved" else "analyzed"}[action]
    rng.shuffle(rows)
    got = {(r.user_id, r.entity_id): r.status for r in preference.statuses(actions(spark, rows)).collect()}
    assert got == state


def test_zero_counters_stay(spark):
    attrs = spark.createDataFrame([(1, "genres", "a"), (2, "genres", "b")], "entity_id long, dim string, key string")
    acts = actions(spark, [(7, 1, "save", 1, 1), (7, 1, "reject", 2, 2), (7, 2, "save", 3, 3), (7, 2, "save", 4, 4)])
    learned = preference.counters(acts, attrs)
    assert {(r.key, r.weight) for r in learned.collect()} == {("a", 0.0), ("b", 2.0)}
    pairs = spark.createDataFrame([(7, 1), (7, 2), (8, 1)], "user_id long, entity_id long")
    got = {(r.user_id, r.entity_id): r.affinity for r in preference.affinity(pairs, attrs, learned, preference.totals(acts)).collect()}
    assert got == {(7, 1): 0.0, (7, 2): 1.0, (8, 1): 0.5}


def test_hiding_twice_changes_nothing(spark):
    results, seen = spark.createDataFrame([(1,), (2,), (3,)], "entity_id long"), spark.createDataFrame([(2,), (2,), (9,)], "entity_id long")
    once = preference.hidden(results, seen)
    assert sorted(r[0] for r in once.collect()) == sorted(r[0] for r in preference.hidden(once, seen).collect()) == [1, 3]


def texts_of(spark, seed, n):
    """Texts, their near copies with edits anywhere, the first words too, and common beginnings."""
    rng, made = random.Random(seed), {"", "a", "ab"}
    for _ in range(n):
        x = rng.choice(["", "brand 17 ", "the "]) + "".join(rng.choices("abcd ", k=rng.randint(1, 30)))
        made.add(x)
        for _ in range(rng.randint(0, 9)):
            i = rng.randint(0, len(x))
            x = rng.choice([x[:i] + rng.choice("abcd") + x[i:], x[:i] + x[i + 1 :], x[:i] + rng.choice("xyz") + x[i + 1 :]])
            made.add(x)
    return sorted(made)


@pytest.mark.parametrize("rate", [0.1, 0.2, 1 - vocab.MATCH])
def test_similarity_join_loses_no_pair(spark, rate):
    left, right = (spark.createDataFrame([(x,) for x in texts_of(spark, seed, 40)], f"{c} string") for seed, c in ((4, "f"), (5, "g")))
    right = right.union(left).distinct()
    every = left.join(right, F.lit(True)).select("f", "g", text.folded_similarity(F.col("f"), F.col("g")).alias("s"))
    want = {(r.f, r.g) for r in every.filter((F.col("s") >= 1 - rate - 1e-9) & (F.col("f") != "") & (F.col("g") != "")).collect()}
    got = {(r.f, r.g) for r in linkage.similar_pairs(left, right, rate).collect()}
    assert want <= got and len(want) > 100
    # pairs may come more than once, but no pair beyond the edits
    assert all(r.s >= 1 - rate - 1e-9 for r in every.join(spark.createDataFrame(sorted(got), "f string, g string"), ["f", "g"]).collect())


def test_best_texts_are_the_best_of_all(spark):
    left = spark.createDataFrame([(x,) for x in texts_of(spark, 6, 40)], "f string")
    firsts = spark.createDataFrame([(x, 7 * i % 1000) for i, x in enumerate(texts_of(spark, 7, 40))], "g string, catalog_id long")
    every = left.join(firsts, F.lit(True)).select("f", "catalog_id", text.folded_similarity(F.col("f"), F.col("g")).alias("s")).filter(F.col("s") >= vocab.MATCH)
    want = {}
    for r in every.collect():
        want[r.f] = min(want.get(r.f, (0, 0)), (-r.s, r.catalog_id))
    assert {r.f: (-r.similarity, r.catalog_id) for r in linkage.best_texts(left, firsts).collect()} == want and "" in want


def test_search_folds_the_query(spark):
    from lodefinder.plans.search import containing

    items = spark.createDataFrame([(1, "Bränd#7 - Steel Song"), (2, "Brand 8"), (3, None)], "id long, title string")
    found = lambda q: sorted(r.id for r in containing(items, q).collect())
    assert found("Brand") == found("bränd") == [1, 2] and found("brand#7") == [1] and found("steel-song BRAND") == [1] and found("#") == [1, 2]


def test_blank_searches_give_no_rows(spark, sf_dir):
    from lodefinder.plans import search as plan

    for blank in ("", " \t "):
        made = plan.search(spark, sf_dir, SearchQuery(text=blank))
        assert made.count() == 0 and made.columns[:2] == ["entity_id", "item_pos"]


def test_empty_preferences(spark):
    """Before anything is kept there is an empty state, and everyone's affinity is neutral."""
    from lodefinder.session import fresh_path

    path = fresh_path(spark, "kept")
    learned, sums = preference.stored(spark, path, preference.COUNTER_SCHEMA), preference.stored(spark, path + "-sums", preference.TOTAL_SCHEMA)
    assert learned.count() == sums.count() == 0 and learned.columns == ["user_id", "dim", "key", "weight"]
    attrs = spark.createDataFrame([(1, "genres", "a")], "entity_id long, dim string, key string")
    pairs = spark.createDataFrame([(7, 1)], "user_id long, entity_id long")
    assert [r.affinity for r in preference.affinity(pairs, attrs, learned, sums).collect()] == [0.5]
    preference.counters(actions(spark, [(7, 1, "save", 1, 1)]), attrs).write.parquet(path)
    assert [tuple(r) for r in preference.stored(spark, path, preference.COUNTER_SCHEMA).collect()] == [(7, "genres", "a", 1.0)]


def test_remote_text(spark):
    df = spark.createDataFrame([("a", ["b", None, ""], None), (None, None, ["c"]), ("", [], [])], "t string, g array<string>, i array<string>")
    assert [r.x for r in df.select(values.remote_text(F.col("t"), F.col("g"), F.col("i")).alias("x")).collect()] == ["a b", "c", ""]
    assert SearchQuery(text="a", genres=("b",), instruments=("c",)).remote_text() == "a b c"
