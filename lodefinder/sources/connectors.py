"""Sources of items by kind, which users can add to, and reading them so that one that fails takes no other with it.

A source is a function that returns a DataFrame of items. The union of all carries each one's kind as a literal, so that
a filter on the kind folds to a constant in the other branches and Catalyst drops their scans: the pruned sources are
not read. No reader of files is written here; Spark's own readers push columns and filters down.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodefinder.session import staged
from lodefinder.sources import tables

Reader = Callable[[SparkSession, str], DataFrame]
_TYPES = {"duration_sec": T.LongType(), "views": T.LongType(), "published_at": T.TimestampType(), "item_pos": T.LongType()}
ITEM_SCHEMA = T.StructType([T.StructField(c, _TYPES.get(c, T.StringType())) for c in ("id", "kind", "native_id", "url", "title", "uploader", "duration_sec", "views", "published_at", "item_pos")])
_READERS: dict[str, Reader] = {}


def register(kind: str, reader: Reader) -> None:
    """Add a source, or replace the one of that kind. What it lacks of the items' columns is null; others are dropped."""
    _READERS[kind] = reader


def unregister(kind: str) -> None:
    _READERS.pop(kind, None)


def kinds() -> list[str]:
    return list(_READERS)


register("youtube", lambda spark, sf_dir: tables.video_items(tables.table(spark, sf_dir, "part")))
register("archive", lambda spark, sf_dir: tables.archive_items(tables.page_docs(tables.table(spark, sf_dir, "pages"))))


def shaped(df: DataFrame, kind: str) -> DataFrame:
    """The items' columns in their types, the kind as a literal."""
    have = set(df.columns)
    columns = [F.lit(kind) if f.name == "kind" else F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType) for f in ITEM_SCHEMA]
    return df.select(*(c.alias(f.name) for c, f in zip(columns, ITEM_SCHEMA, strict=True)))


def items(spark: SparkSession, sf_dir: str, wanted: list[str] | None = None) -> DataFrame:
    """The items of all sources, or of the wanted kinds; unknown kinds give none. Lazy; see landed for sources that may fail."""
    out = spark.createDataFrame([], ITEM_SCHEMA)
    for kind, reader in _READERS.items():
        if not wanted or kind in wanted:
            out = out.unionByName(shaped(reader(spark, sf_dir), kind))
    return out


def landed(spark: SparkSession, sf_dir: str, wanted: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, report): each source written down by itself; one that fails gives no items and a line of error.

    report has a row for each source asked for: kind, rows, error (null where it went well). A source fails when its
    reader raises, has columns of the wrong type, or when its rows are computed; the others are not computed again.
    """
    out, report = spark.createDataFrame([], ITEM_SCHEMA), []
    for kind, reader in _READERS.items():
        if wanted and kind not in wanted:
            continue
        try:
            part = staged(shaped(reader(spark, sf_dir), kind), f"items-{kind}")
            report.append((kind, part.count(), None))
            out = out.unionByName(part)
        except Exception as e:  # whatever a source raises, the others go on; the report says what it was
            report.append((kind, 0, (str(e).strip().splitlines() or [type(e).__name__])[0][:500]))
    return out, spark.createDataFrame(report, "kind string, rows long, error string")


def parsed(rows: DataFrame, json_col: str, schema: str) -> DataFrame:
    """rows with the columns of schema read from JSON texts, and corrupt: the text where it is no such JSON, else null.

    A null text gives nulls and is not corrupt. Broken rows stay, with nulls, so that they can be counted or kept apart.
    """
    fields = T.StructType.fromDDL(schema)
    corrupt = "_".join(["corrupt", *fields.names])
    read = F.from_json(json_col, T.StructType([*fields.fields, T.StructField(corrupt, T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
    return rows.withColumn(corrupt, read).select("*", *(F.col(f"{corrupt}.{n}").alias(n) for n in fields.names), F.col(f"{corrupt}.{corrupt}").alias("corrupt")).drop(corrupt)


def archive_search(docs: DataFrame, words: Column, media: str = "audio", limit: int = 20) -> DataFrame:
    """Archive rows (as tables.archive_items takes, and mediatype) of one media type whose title or creator holds the words: the first by position."""
    from lodefinder.functions import text

    held = text.folded(F.concat_ws(" ", "title", F.array_join("creator", " ")))
    return docs.filter(F.col("mediatype") == media).filter(held.contains(text.folded(words))).orderBy("pos").limit(limit)


RELEASE = "id long, title string, year int, artists array<struct<name:string>>, labels array<struct<name:string>>, country string, genres array<string>, styles array<string>, extraartists array<struct<name:string,role:string>>, community struct<want:long,have:long>"


def releases(payloads: DataFrame, json_col: str) -> DataFrame:
    """Catalog rows from release payloads: artists joined by commas or 'Unknown', the first label, year 0 as unknown, credits.

    A payload that can not be read gives a row of nulls with the text in corrupt. Columns beside json_col are kept.
    """
    kept = [c for c in payloads.columns if c != json_col]
    fields = T.StructType.fromDDL(RELEASE)
    made = payloads.select(*kept, F.from_json(json_col, T.StructType([*fields.fields, T.StructField("corrupt", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}).alias("r"))
    names = F.filter(F.col("r.artists.name"), lambda n: n.isNotNull() & (n != ""))
    return made.select(
        *kept, F.col("r.id").alias("catalog_id"),
        F.when(F.col("r.corrupt").isNull(), F.coalesce(F.nullif(F.array_join(names, ", "), F.lit("")), F.lit("Unknown"))).alias("artist"),
        F.col("r.title").alias("title"), F.nullif("r.year", F.lit(0)).alias("year"), F.try_element_at("r.labels", F.lit(1))["name"].alias("label"), F.col("r.country").alias("country"),
        F.col("r.genres").alias("genres"), F.col("r.styles").alias("styles"), F.col("r.extraartists").alias("credits"), F.col("r.community.want").alias("want"), F.col("r.community.have").alias("have"), F.col("r.corrupt").alias("corrupt"),
    )
