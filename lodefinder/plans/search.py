"""Search from end to end: items, candidates, matches, scores, hiding, ranking. One lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodefinder.functions import text
from lodefinder.operators import linkage, preference, scoring
from lodefinder.operators.scoring import SearchQuery
from lodefinder.sources import connectors, tables

#: Items taken of each source, and candidates enriched for one search.
PER_SOURCE, ENRICHED = 20, 24


def first_per_source(items: DataFrame, n: int) -> DataFrame:
    """The first n items of each kind by position."""
    w = Window.partitionBy("kind").orderBy("item_pos")
    return items.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def containing(items: DataFrame, query_text: str) -> DataFrame:
    """Items whose title holds every word of the query, both folded: in place of a remote index."""
    words = F.split(text.folded(F.lit(query_text)), r"\s+")  # a constant, so Spark folds it once
    return items.filter(text.bound(text.folded(F.col("title")), lambda title: F.forall(words, lambda w: title.contains(w))))


def discovered(spark: SparkSession, sf_dir: str, q: SearchQuery, per_source: int | None = PER_SOURCE) -> DataFrame:
    items = containing(connectors.items(spark, sf_dir, list(q.sources)), q.text)
    return first_per_source(items, per_source) if per_source else items


def all_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of every source as an enriched track."""
    return linkage.tracks(linkage.candidates(connectors.items(spark, sf_dir)), tables.catalog(spark, sf_dir), tables.recordings(spark, sf_dir), tables.as_of())


def track_affinity(spark: SparkSession, sf_dir: str, tracks: DataFrame, user_id: int) -> DataFrame:
    """Tracks with their affinity to one user's actions."""
    attrs = tables.attributes(spark, sf_dir)
    acts = tables.actions(tables.table(spark, sf_dir, "events").filter(F.col("user_id") == user_id))
    # a track takes the attributes of the release it is linked to
    pairs = tracks.filter("catalog_id IS NOT NULL").select(F.lit(user_id).cast("long").alias("user_id"), F.col("catalog_id").alias("entity_id")).distinct()
    learned = preference.counters(acts, attrs)
    found = preference.affinity(pairs, attrs, learned, preference.totals(acts)).select(F.col("entity_id").alias("catalog_id"), "affinity")
    return tracks.join(found, "catalog_id", "left").withColumn("affinity", F.coalesce("affinity", F.lit(0.5)))


def seen_entities(spark: SparkSession, sf_dir: str, user_id: int) -> DataFrame:
    acts = tables.actions(tables.table(spark, sf_dir, "events").filter(F.col("user_id") == user_id))
    return acts.select(F.concat(F.lit("release:"), F.col("entity_id").cast("string")).alias("entity_id")).distinct()


def search(spark: SparkSession, sf_dir: str, q: SearchQuery, user_id: int | None = None, hide_seen: bool = True, per_source: int | None = PER_SOURCE, enriched: int | None = ENRICHED) -> DataFrame:
    """Ranked tracks for a query; a blank one gives none. Ties in score keep the order of the sources."""
    items = discovered(spark, sf_dir, q, per_source)
    if not q.text.strip():
        items = items.filter(F.lit(False))
    if enriched:
        items = items.orderBy("item_pos").limit(enriched)
    made = linkage.tracks(linkage.candidates(items), tables.catalog(spark, sf_dir), tables.recordings(spark, sf_dir), tables.as_of())
    if user_id is not None:
        made = track_affinity(spark, sf_dir, made, user_id)
        if hide_seen:
            made = preference.hidden(made, seen_entities(spark, sf_dir, user_id))
    ranked = scoring.scored(made, q)
    return ranked.orderBy(F.desc("dig_score"), "item_pos").select("entity_id", "item_pos", "artist", "name", "year", "dig_score", "tier", F.array_join("reasons", "; ").alias("reasons"))
