"""Adapters: items, catalog, actions and profiles as views of the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodefinder.functions import text
from lodefinder.functions.values import bpm_bucket, decade

#: "Now" for every age; results must not depend on the day they are computed.
AS_OF = "2024-02-01"
SUFFIXES = [" [%d bpm F# minor]", " [Am groove]", " [%d BPM Bb maj]", " [A Minor x]", " [Em7]", " [key of dreams]", ""]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def video_items(part: DataFrame) -> DataFrame:
    """One video for each part, with a noisy title in the manner of uploads."""
    k = F.col("p_partkey")
    bpm = (F.lit(60) + k % 90).cast("string")
    suffix = F.lit("")
    for i, s in enumerate(SUFFIXES):
        left, mark, right = s.partition("%d")
        suffix = F.when(k % 7 == i, F.concat(F.lit(left), bpm, F.lit(right)) if mark else F.lit(s)).otherwise(suffix)
    title = F.concat("p_brand", F.when(k % 9 == 0, " ").otherwise(" - "), "p_name", F.lit(" ("), (F.lit(1950) + F.col("p_size")).cast("string"), F.lit(") [Vinyl Rip]"), suffix)
    return part.select(
        F.concat(F.lit("youtube:"), k.cast("string")).alias("id"),
        F.lit("youtube").alias("kind"),
        k.cast("string").alias("native_id"),
        F.concat(F.lit("https://video.example.com/watch?v="), k.cast("string")).alias("url"),
        title.alias("title"),
        F.lit(None).cast("string").alias("uploader"),
        (F.col("p_size") * 45 - 30).cast("long").alias("duration_sec"),
        F.when(k % 17 != 0, (k * 7919) % 5000).cast("long").alias("views"),
        F.timestamp_micros(F.unix_micros(as_of()) - (k % 400) * 86_400_000_000).alias("published_at"),
        k.cast("long").alias("item_pos"),
    )


def archive_items(docs: DataFrame) -> DataFrame:
    """Archive rows: identifier, title, creator (array), year, downloads, pos become items.

    The title is creator - title, without what is missing, else the title, else the identifier; several creators are
    joined by commas, the first is the uploader. No downloads means unknown. The date is the year's first day.
    """
    full = F.concat_ws(" - ", F.nullif(F.array_join("creator", ","), F.lit("")), F.nullif("title", F.lit("")))
    year = F.nullif("year", F.lit(0))
    return docs.select(
        F.concat(F.lit("archive:"), "identifier").alias("id"),
        F.lit("archive").alias("kind"),
        F.col("identifier").alias("native_id"),
        F.concat(F.lit("https://archive.example.com/details/"), "identifier").alias("url"),
        F.coalesce(F.nullif(full, F.lit("")), F.col("title"), F.col("identifier")).alias("title"),
        F.try_element_at("creator", F.lit(1)).alias("uploader"),
        F.lit(None).cast("long").alias("duration_sec"),
        F.nullif("downloads", F.lit(0)).cast("long").alias("views"),
        F.make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("published_at"),
        F.col("pos").cast("long").alias("item_pos"),
    )


#: Item positions of archive rows start here, after all videos.
ARCHIVE_START = 1 << 40


def page_docs(pages: DataFrame) -> DataFrame:
    """Pages as archive rows: their title, their site as creator, page number modulo 50 as downloads."""
    return pages.select(
        F.col("page_id").cast("string").alias("identifier"),
        F.nullif(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("")).alias("title"),
        F.array_compact(F.array(F.nullif(F.regexp_extract("url", "://([^/?#]*)", 1), F.lit("")))).alias("creator"),
        F.when(F.col("page_id") % 3 == 0, (F.lit(1960) + F.col("page_id") % 60)).cast("int").alias("year"),
        (F.col("page_id") % 50).alias("downloads"),
        (F.lit(ARCHIVE_START) + F.col("page_id")).alias("pos"),
    )


CREDITS = ["Bass Guitar", "Electric Piano", "Drums, Percussion", "Producer", "Bassoon"]


def credited_role():
    return F.element_at(F.array(*map(F.lit, CREDITS)), (F.col("p_partkey") % 5 + 1).cast("int"))


def makers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, returns, s_suppkey, s_name, n_name): each part's returned lines, and its first supplier and their nation."""
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_suppkey").alias("s_suppkey"), F.sum((F.col("l_returnflag") == "R").cast("long")).alias("returns"))
    named = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name")
    return counts.join(named, "s_suppkey", "left")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A release for each brand and name, but for those whose smallest part number is divisible by 3."""
    part = table(spark, sf_dir, "part")
    first = part.groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("p_partkey")).filter("p_partkey % 3 <> 0").select("p_partkey")
    k = F.col("p_partkey")
    credit = F.struct(F.col("s_name").alias("name"), credited_role().alias("role"))
    return (
        part.join(first, "p_partkey")
        .join(makers(spark, sf_dir), "p_partkey", "left")
        .select(
            k.alias("catalog_id"),
            F.col("p_brand").alias("artist"),
            F.col("p_name").alias("title"),
            (F.lit(1950) + F.col("p_size")).cast("int").alias("year"),
            F.col("s_name").alias("label"),
            F.col("n_name").alias("country"),
            F.array("p_type").alias("genres"),
            F.split("p_name", " ").alias("styles"),
            F.when(k % 4 == 0, F.array().cast("array<struct<name:string,role:string>>")).otherwise(F.array(credit)).alias("credits"),
            F.when(k % 11 != 0, F.coalesce("returns", F.lit(0)) * (k % 5)).alias("want"),
            (k % 13).alias("have"),
        )
    )


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three recording ids for each brand and name, in order of score."""
    part = table(spark, sf_dir, "part").filter("p_partkey % 2 = 0")
    return part.select(
        F.col("p_brand").alias("artist"),
        F.col("p_name").alias("title"),
        F.concat(F.lit("rec-"), F.col("p_partkey").cast("string")).alias("recording_id"),
        F.concat(F.lit("rel-"), F.col("p_partkey").cast("string")).alias("release_id"),
        (F.lit(50) + F.col("p_partkey") % 50).cast("double").alias("score"),
        F.col("p_partkey").alias("pos"),
    )


ACTIONS = {"purchase": "save", "click": "analyze", "view": "seen", "error": "reject"}


def actions(events: DataFrame) -> DataFrame:
    """(user_id, entity_id, action, ts, event_id) of the events that are actions."""
    kind = F.create_map(*(F.lit(x) for pair in ACTIONS.items() for x in pair))
    return events.filter(F.col("event_type").isin(*ACTIONS)).select(
        "user_id", F.get_json_object("props", "$.k").cast("long").alias("entity_id"), kind[F.col("event_type")].alias("action"), F.col("ts").cast("timestamp").alias("ts"), "event_id"
    )


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, dim, key): what a track's preference counters are kept by, in all ten dimensions.

    Instruments are those of its credits, else those that its title names; feels and textures are hints in title and tags.
    """
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    titles = video_items(part).select(F.col("item_pos").alias("p_partkey"), "title")
    joined = part.join(titles, "p_partkey").join(makers(spark, sf_dir), "p_partkey", "left")
    styles = F.split("p_name", " ")
    credited = F.array_compact(F.array(F.when(k % 4 != 0, text.role_instrument(credited_role()))))
    tagged = joined.select(
        k.alias("entity_id"), "p_type", "p_brand", "s_name", "n_name", styles.alias("styles"),
        F.when(F.size(credited) > 0, credited).otherwise(text.instruments_in(F.col("title"))).alias("instruments"),
        text.mood(F.col("title"), F.concat(F.array("p_type"), styles)).alias("mood"),
        decade(F.lit(1950) + F.col("p_size")).alias("era"), bpm_bucket((F.lit(60) + k % 90).cast("double")).alias("bucket"),
    )
    pairs = lambda dim, keys: F.transform(keys, lambda x: F.struct(F.lit(dim).alias("dim"), x.alias("key")))
    many = {"genres": F.array("p_type"), "styles": F.col("styles"), "instruments": F.col("instruments"), "feels": F.col("mood.feels"), "textures": F.col("mood.textures")}
    one = {"eras": "era", "countries": "n_name", "labels": "s_name", "artists": "p_brand", "bpm_buckets": "bucket"}
    every = F.concat(*(pairs(d, c) for d, c in many.items()), *(pairs(d, F.array(c)) for d, c in one.items()))
    return tagged.select("entity_id", F.explode(every).alias("a")).select("entity_id", "a.dim", "a.key").filter("key IS NOT NULL AND key <> ''")
