"""Preferences learned from actions, and the status that actions leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodefinder.functions.values import clamp

#: Dimensions that a track's affinity is read from; feels and textures are only learned.
READ = ["genres", "styles", "instruments", "eras", "countries", "labels", "artists", "bpm_buckets"]


def weight_of(action: Column, learn_on_analyze: bool = False) -> Column:
    w = F.when(action == "save", 1).when(action == "reject", -1)
    return w.when(action == "analyze", 1) if learn_on_analyze else w


def counters(actions: DataFrame, attributes: DataFrame, learn_on_analyze: bool = False) -> DataFrame:
    """(user_id, dim, key, weight): sums of +1 for a save and -1 for a rejection; sums of 0 stay.

    Actions are summed by user and track before they meet the tracks' attributes.
    """
    weighed = actions.withColumn("w", weight_of(F.col("action"), learn_on_analyze)).filter("w IS NOT NULL").groupBy("user_id", "entity_id").agg(F.sum("w").alias("w"))
    return weighed.join(attributes, "entity_id").groupBy("user_id", "dim", "key").agg(F.sum("w").cast("double").alias("weight"))


def totals(actions: DataFrame, learn_on_analyze: bool = False) -> DataFrame:
    return actions.withColumn("w", weight_of(F.col("action"), learn_on_analyze)).filter("w IS NOT NULL").groupBy("user_id").agg(F.sum("w").cast("double").alias("total"))


def affinity(pairs: DataFrame, attributes: DataFrame, learned: DataFrame, sums: DataFrame) -> DataFrame:
    """pairs (user_id, entity_id) with affinity: the mean of each attribute's weight over its dimension's largest.

    A dimension that the user has no counter for is skipped, a missing key in one that they have counts 0. 0.5 without
    a positive total or any signal.
    """
    tops = learned.groupBy("user_id", "dim").agg(F.greatest(F.lit(1.0), F.max("weight")).alias("top"))
    keyed = pairs.distinct().join(attributes.filter(F.col("dim").isin(READ)), "entity_id")
    signals = keyed.join(tops, ["user_id", "dim"]).join(learned, ["user_id", "dim", "key"], "left")
    mean = signals.groupBy("user_id", "entity_id").agg(F.avg(F.coalesce("weight", F.lit(0.0)) / F.col("top")).alias("mean"))
    joined = pairs.join(mean, ["user_id", "entity_id"], "left").join(sums, "user_id", "left")
    value = F.when((F.coalesce("total", F.lit(0.0)) <= 0) | F.col("mean").isNull(), F.lit(0.5)).otherwise(clamp(F.col("mean")))
    return joined.select("user_id", "entity_id", value.alias("affinity"))


COUNTER_SCHEMA, TOTAL_SCHEMA = "user_id long, dim string, key string, weight double", "user_id long, total double"


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What was kept under a path, or the empty state of that schema where nothing has been kept yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def last_of(condition: Column, *columns: str) -> Column:
    return F.max(F.when(condition, F.struct("ts", "event_id", *columns)))


def status_of(hard: Column, analysis: Column) -> Column:
    """From the last save or rejection and the last analysis: an analysis after a rejection counts, after a save not."""
    later = analysis.isNotNull() & (hard.isNull() | (F.struct(analysis["ts"], analysis["event_id"]) > F.struct(hard["ts"], hard["event_id"])))
    return F.when(hard["action"] == "save", "saved").when(later, "analyzed").when(hard["action"] == "reject", "rejected").otherwise("seen")


def statuses(actions: DataFrame) -> DataFrame:
    """(user_id, entity_id, status): the fold of all actions in order of time, as one aggregation.

    seen only counts if there is nothing else; a save stays a save when it is analyzed. Two maxima hold all that
    matters, so partial aggregation applies and the order of input rows does not matter.
    """
    soft = F.col("action")
    found = actions.groupBy("user_id", "entity_id").agg(last_of(soft.isin("save", "reject"), "action").alias("hard"), last_of(soft == "analyze").alias("analysis"))
    return found.select("user_id", "entity_id", status_of(F.col("hard"), F.col("analysis")).alias("status"))


def hidden(results: DataFrame, seen: DataFrame, id_col: str = "entity_id") -> DataFrame:
    """Results without those already seen. seen is a snapshot taken before these results are marked."""
    return results.join(seen.select(id_col).distinct(), id_col, "left_anti")


def dropped(results: DataFrame, actions: DataFrame) -> DataFrame:
    """Results without what was rejected since they were shown; a later save does not bring a row back."""
    return hidden(results, actions.filter(F.col("action") == "reject"))


def mark_seen(stored: DataFrame, new: DataFrame, order: str = "item_pos") -> DataFrame:
    """Stored rows, and new ones whose id is not stored, with status 'seen'; of equal ids the first."""
    first = new.groupBy("entity_id").agg(F.min(F.struct(order, *(c for c in new.columns if c not in ("entity_id", order)))).alias("r")).select("entity_id", "r.*").drop("status")
    added = first.join(stored.select("entity_id"), "entity_id", "left_anti").withColumn("status", F.lit("seen"))
    return stored.unionByName(added.select(*stored.columns))


def upsert(stored: DataFrame, changes: DataFrame, key: str = "entity_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Stored rows replaced by the last change of their key; keys that are new are added."""
    last = changes.groupBy(key).agg(F.max(F.struct(*order, *(c for c in changes.columns if c not in (key, *order)))).alias("r")).select(key, "r.*").drop(*order)
    return stored.join(last.select(key), key, "left_anti").unionByName(last.select(*stored.columns))


def merge_analysis(stored: DataFrame, analysis: DataFrame, fields: tuple[str, ...] = ("bpm", "key", "instruments")) -> DataFrame:
    """Field by field what the analysis found, else what was stored; 'saved' stays, anything else becomes 'analyzed'."""
    new = analysis.select("entity_id", *(F.col(f).alias(f"new_{f}") for f in fields), F.lit(True).alias("__hit"))
    joined = stored.join(new, "entity_id", "left")
    merged = {f: F.coalesce(f"new_{f}", f) for f in fields}
    status = F.when(F.col("__hit").isNotNull() & (F.coalesce("status", F.lit("")) != "saved"), "analyzed").otherwise(F.col("status"))
    return joined.withColumns(merged | {"status": status}).select(*stored.columns)


def collection(statuses_: DataFrame) -> DataFrame:
    """What was kept: saved or analyzed."""
    return statuses_.filter(F.col("status").isin("saved", "analyzed"))
