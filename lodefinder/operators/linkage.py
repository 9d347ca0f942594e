"""Candidates from items, their best catalog match, and enriched tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodefinder.functions import text, values, vocab
from lodefinder.session import staged


def candidates(items: DataFrame) -> DataFrame:
    """Items with what their raw titles say: cleaned title, artist, title, year, bpm, key, confidence of the split."""
    raw = F.col("title")
    artist, title = text.artist_and_title(raw)
    split = F.coalesce(artist, F.lit("")) != ""
    return items.select(
        "*",
        text.clean_title(raw).alias("cleaned_title"),
        artist.alias("c_artist"),
        title.alias("c_title"),
        text.year_of(raw).alias("c_year"),
        text.bpm_of(raw).alias("c_bpm"),
        text.key_of(raw).alias("c_key"),
        F.when(split, vocab.CONFIDENCE["split"]).otherwise(vocab.CONFIDENCE["unsplit"]).alias("parse_confidence"),
    )


def search_text() -> Column:
    """What a candidate is looked up by: artist and title."""
    return text.trimmed(F.concat_ws(" ", F.col("c_artist"), F.coalesce("c_title", "cleaned_title")))


def block_key(folded: Column) -> Column:
    """The first two words of a folded text."""
    return F.array_join(F.slice(F.split(folded, " "), 1, 2), " ")


#: Shares of edits that a search allows, one after the other, and how many segments more than needed a text is cut into.
#: Fixed at the end by the similarity that a match needs: 1 - MATCH.
RATES, SPARE, SHORTEST = (0.1, 1 - vocab.MATCH), 2, 3
#: Above rounding: 1 - edits / length is computed in doubles.
SLACK = 1e-9


def edits(length: Column, rate: float) -> Column:
    """The most edits that leave two texts, the longer of this length, similar enough."""
    return F.floor(length * rate + SLACK).cast("int")


def cut(g_length: Column, k: Column) -> Column:
    """(place, start, size) of even segments: one more than k and a few to spare, as long as they keep a few letters."""
    n = F.greatest(k + 1, F.least(k + 1 + SPARE, F.floor(g_length / SHORTEST).cast("int")))
    start = lambda i: F.floor(i * g_length / n).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("place"), start(i).alias("start"), (start(i + 1) - start(i)).alias("size")))


def segments(texts: DataFrame, rate: float) -> DataFrame:
    """(g, length, k, place, segment): the k + 1 rarest segments of each text, for every k that a partner may ask for.

    k edits leave all but k of the segments whole, so that k + 1 of them, whichever, always hold a whole one: the most
    frequent can be left out.
    """
    longest = F.floor(F.length("g") / (1 - rate) + SLACK).cast("int")
    sized = texts.select("g", F.length("g").alias("length"), F.explode(F.sequence(edits(F.length("g"), rate), edits(longest, rate))).alias("k")).filter("length > 0")
    each = sized.select("g", "length", "k", F.explode(cut(F.col("length"), F.col("k"))).alias("c"))
    each = each.select("g", "length", "k", "c.place", F.substring("g", F.col("c.start") + 1, F.col("c.size")).alias("segment"))
    key = ["length", "k", "place", "segment"]
    counted = each.join(each.groupBy(*key).agg(F.count("*").alias("n")), key)
    rare = Window.partitionBy("g", "k").orderBy("n", "place")
    return counted.withColumn("r", F.row_number().over(rare)).filter(F.col("r") <= F.col("k") + 1).select("g", *key)


def probes(texts: DataFrame, lengths: DataFrame, rate: float) -> DataFrame:
    """(f, length, k, place, segment): what a text of that length would have to share with f, at all places it can stand.

    A whole segment that x places shift is left of at least |x| edits and right of |x + difference of lengths|.
    """
    own = F.length("f")
    near = texts.select("f", own.alias("own"), F.explode(F.sequence(F.greatest(F.lit(1), F.ceil(own * (1 - rate) - SLACK).cast("int")), F.floor(own / (1 - rate) + SLACK).cast("int"))).alias("length")).filter("own > 0")
    near = near.join(lengths, "length").withColumn("k", edits(F.greatest("own", "length"), rate)).withColumn("more", F.col("length") - F.col("own"))
    # |x| + |x + more| <= k
    low, high = -F.floor((F.col("k") + F.col("more")) / 2).cast("int"), F.floor((F.col("k") - F.col("more")) / 2).cast("int")
    each = near.filter(F.abs("more") <= F.col("k")).select("f", "own", "length", "k", low.alias("low"), high.alias("high"), F.explode(cut(F.col("length"), F.col("k"))).alias("c"))
    at = F.explode(F.sequence(F.col("c.start") + F.col("low"), F.col("c.start") + F.col("high"))).alias("at")
    placed = each.select("f", "own", "length", "k", "c.place", "c.size", at).filter("at >= 0 AND at + size <= own")
    return placed.select("f", "length", "k", "place", F.substring("f", F.col("at") + 1, F.col("size")).alias("segment")).distinct()


def similar_pairs(left: DataFrame, right: DataFrame, rate: float) -> DataFrame:
    """(f, g, similarity) of all texts with at most that share of edits: none is lost, a pair may come more than once.

    left has distinct texts f, right distinct texts g. Texts meet by an equality join on segments, never as all pairs.
    """
    index = segments(right, rate)
    met = probes(left, right.select(F.length("g").alias("length")).distinct(), rate).join(index, ["length", "k", "place", "segment"]).select("f", "g", "k")
    return met.filter(F.levenshtein("f", "g") <= F.col("k")).select("f", "g", text.folded_similarity(F.col("f"), F.col("g")).alias("similarity"))


def best_texts(left: DataFrame, firsts: DataFrame) -> DataFrame:
    """(f, catalog_id, similarity): the most similar of firsts (g, catalog_id) for each text f, the smaller id of equals.

    Equal texts are joined as they are. What finds none is searched with few edits, then with more: a text that has a
    partner within a share of edits has its best one there, so that each search serves the texts that the ones before
    left. What the first searches find is written down, as the last one reads what they leave.
    """
    out = left.join(firsts, F.col("f") == F.col("g")).select("f", "catalog_id", F.lit(1.0).alias("similarity"))
    for rate in RATES:
        met = similar_pairs(left.join(out.select("f"), "f", "left_anti"), firsts.select("g"), rate).join(firsts, "g")
        best = met.groupBy("f").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "catalog_id")).alias("b"))
        found = best.select("f", "b.catalog_id", (-F.col("b.s")).alias("similarity"))
        out = out.unionByName(found.filter(F.col("similarity") >= vocab.MATCH) if rate == RATES[-1] else staged(found, "similar"))
    return out


def best_matches(found: DataFrame, catalog: DataFrame) -> DataFrame:
    """(item_pos, catalog_id, similarity): each candidate's most similar release of all, the first of equals, if similar enough."""
    named = found.select("item_pos", text.folded(search_text()).alias("f"))
    releases = catalog.select("catalog_id", text.folded(F.concat_ws(" ", "artist", "title")).alias("g"))
    firsts = staged(releases.groupBy("g").agg(F.min("catalog_id").alias("catalog_id")), "releases")
    texts = staged(named.select("f").distinct(), "texts")
    return named.join(best_texts(texts, firsts), "f").select("item_pos", "catalog_id", "similarity")


def nearest_by_length(found: DataFrame, catalog: DataFrame, n: int = 10) -> DataFrame:
    """(item_pos, catalog_id, rank): in each block, the n releases nearest to the candidate in length."""
    named = found.select("item_pos", text.folded(search_text()).alias("f")).withColumn("block", block_key(F.col("f")))
    releases = catalog.select("catalog_id", text.folded(F.concat_ws(" ", "artist", "title")).alias("g")).withColumn("block", block_key(F.col("g")))
    pairs = named.join(releases, "block").withColumn("gap", F.abs(F.length("f") - F.length("g")))
    w = Window.partitionBy("item_pos").orderBy("gap", "catalog_id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("item_pos", "catalog_id", "rank")


def first_recordings(recordings: DataFrame) -> DataFrame:
    """The first recording for each artist and title."""
    best = recordings.groupBy("artist", "title").agg(F.min(F.struct("pos", "recording_id", "release_id")).alias("r"))
    return best.select("artist", "title", "r.recording_id", "r.release_id")


def tracks(found: DataFrame, catalog: DataFrame, recordings: DataFrame, as_of: Column) -> DataFrame:
    """Enriched tracks: the matched release or a fallback, recording ids if confirmed, provenanced fields, rarity.

    One row for each candidate; two items may resolve to one release and stay two rows.
    """
    matched = best_matches(found, catalog).withColumnRenamed("similarity", "match_score")
    release = catalog.select("catalog_id", *(F.col(c).alias(f"r_{c}") for c in catalog.columns if c != "catalog_id"))
    joined = found.join(matched, "item_pos", "left").join(release, "catalog_id", "left")
    hit = F.col("catalog_id").isNotNull()
    guess = text.slug(search_text())
    instruments = F.array_distinct(F.array_compact(F.transform("r_credits", lambda c: text.role_instrument(c["role"]))))
    mentioned = text.instruments_in(F.col("title"))
    tags = F.concat(F.coalesce("r_genres", F.array().cast("array<string>")), F.coalesce("r_styles", F.array().cast("array<string>")))
    empty = F.array().cast("array<string>")
    out = joined.select(
        "item_pos", "id", "kind", "title", "duration_sec", "views", "published_at", "match_score", "catalog_id",
        F.when(hit, F.concat(F.lit("release:"), F.col("catalog_id").cast("string"))).otherwise(F.concat(F.lit("guess:"), F.coalesce(F.nullif(guess, F.lit("")), "native_id"))).alias("entity_id"),
        F.when(hit, F.col("r_artist")).otherwise(F.coalesce(F.nullif("c_artist", F.lit("")), F.lit("Unknown"))).alias("artist"),
        F.when(hit, F.col("r_title")).otherwise(F.coalesce("c_title", "cleaned_title")).alias("name"),
        F.coalesce(F.nullif("r_year", F.lit(0)), "c_year").alias("year"),
        F.col("r_label").alias("label"), F.col("r_country").alias("country"),
        F.coalesce("r_genres", empty).alias("genres"), F.coalesce("r_styles", empty).alias("styles"),
        F.coalesce(F.size("r_credits"), F.lit(0)).alias("n_credits"),
        (hit & (F.col("match_score") >= vocab.CONFIRMED)).alias("confirmed"),
        values.provenance(F.col("c_bpm"), "youtube_title", "parsed", vocab.CONFIDENCE["bpm"], as_of).alias("bpm"),
        values.provenance(F.col("c_key"), "youtube_title", "parsed", vocab.CONFIDENCE["key"], as_of).alias("key"),
        values.inferred(text.mood(F.col("title"), tags), vocab.CONFIDENCE["mood"], as_of).alias("mood"),
        F.when(F.coalesce(F.size(instruments), F.lit(0)) > 0, values.confirmed(instruments, "discogs", as_of))
        .when(F.size(mentioned) > 0, values.confirmed(mentioned, "youtube_title", as_of, vocab.CONFIDENCE["instruments"])).alias("instruments"),
        F.col("r_want").alias("want"), F.col("r_have").alias("have"),
        F.when(F.col("kind") == "youtube", F.col("views")).alias("video_views"),
        values.days_since(F.col("published_at"), as_of).alias("age_days"),
    )
    ids = first_recordings(recordings).select(F.col("artist").alias("i_artist"), F.col("title").alias("i_title"), "recording_id", "release_id")
    return out.join(ids, F.col("confirmed") & (F.col("artist") == F.col("i_artist")) & (F.col("name") == F.col("i_title")), "left").drop("i_artist", "i_title")
