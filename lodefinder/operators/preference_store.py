"""Preferences kept as bucketed tables, so that learning and scoring join without a shuffle.

Four tables lie under one folder:

* history (user_id, entity_id, w), bucketed by entity_id: what each lot of actions adds; w is null where an action only shows a track;
* attributes (entity_id, dim, key), bucketed by entity_id: it meets the history bucket by bucket;
* keyed (user_id, entity_id, dim, key, w), bucketed by (user_id, dim, key): the history with its attributes;
* signals (user_id, dim, key, weight, signal), bucketed by (user_id, dim, key): the counters, and what each adds to an
  affinity; it meets keyed bucket by bucket.

A user with very many actions is spread over the buckets by dimension and key, as buckets by user alone would not do.
What is still shuffled is the keyed table once for each learning, as it is written, and sums and maxima that are
aggregated before they travel. Learning writes a new version beside the old one and then names it, so that readers
of the old one are not disturbed, and a learning that fails leaves the old one in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodefinder.functions.values import clamp
from lodefinder.operators.preference import READ, weight_of

BY_ENTITY, BY_KEY = ("entity_id",), ("user_id", "dim", "key")
SCHEMAS = {
    "history": ("user_id BIGINT, entity_id BIGINT, w BIGINT", BY_ENTITY),
    "attributes": ("entity_id BIGINT, dim STRING, key STRING", BY_ENTITY),
    "keyed": ("user_id BIGINT, entity_id BIGINT, dim STRING, key STRING, w BIGINT", BY_KEY),
    "signals": ("user_id BIGINT, dim STRING, key STRING, weight DOUBLE, signal DOUBLE", BY_KEY),
}


class PreferenceStore:
    """Counters under a folder; opening the folder again, also in another session, finds them.

    buckets is fixed when the folder is first written; it should grow with the data, as one task reads one bucket.
    Actions with a null user or track are kept and teach nothing; an empty store scores no pair.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.name = "lodefinder_" + "".join(c if c.isalnum() else "_" for c in self.path).lower()
        self.state = spark.read.schema("buckets INT, version INT, attributes INT").json(self._made("state")).collect() if self._exists("state") else []
        last = max(self.state, key=lambda r: (r["version"], r["attributes"]), default=None)
        self.buckets = last["buckets"] if last else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.version, self.described = (last["version"], last["attributes"]) if last else (0, 0)
        if not last:
            self._note()

    def _made(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _exists(self, name: str) -> bool:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._made(name))
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)

    def _note(self) -> None:
        """One line for each state; the last one counts. It is written when everything that it names is complete."""
        row = (self.buckets, self.version, self.described)
        self.spark.createDataFrame([row], "buckets INT, version INT, attributes INT").coalesce(1).write.mode("append").json(self._made("state"))

    def _table(self, kind: str, version: int | None = None) -> str:
        """The table's name; it is declared over its folder where this session does not know it."""
        schema, keys = SCHEMAS[kind]
        folder = kind if version is None else f"{kind}-{version}"
        table = f"{self.name}_{folder.replace('-', '_')}"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({schema}) USING parquet CLUSTERED BY ({', '.join(keys)}) INTO {self.buckets} BUCKETS LOCATION '{self._made(folder)}'")
        return table

    def _write(self, rows: DataFrame, table: str, kind: str) -> None:
        """Rows into their buckets, one file for each bucket and call, in place of what a failed call has left."""
        rows.repartition(self.buckets, *SCHEMAS[kind][1]).select(*self.spark.table(table).columns).write.insertInto(table, overwrite=kind != "history")

    def describe(self, attributes: DataFrame) -> None:
        """(entity_id, dim, key) of all tracks, in place of what was there; the next learning uses them."""
        self._write(attributes, self._table("attributes", self.described + 1), "attributes")
        self.described += 1
        self._note()

    def add(self, actions: DataFrame, learn_on_analyze: bool = False) -> None:
        """More actions (user_id, entity_id, action). They are summed by user and track first; order does not matter."""
        weight = weight_of(F.col("action"), learn_on_analyze).cast("long")
        self._write(actions.groupBy("user_id", "entity_id").agg(F.sum(weight).alias("w")), self._table("history"), "history")

    def pairs(self) -> DataFrame:
        """(user_id, entity_id, w) of all actions so far; each bucket holds all rows of its tracks, so nothing is shuffled."""
        return self.spark.table(self._table("history")).groupBy("user_id", "entity_id").agg(F.sum("w").alias("w"))

    def learn(self) -> None:
        """Counters and signals of all actions so far, as a new version."""
        version = self.version + 1
        attributes = self.spark.table(self._table("attributes", self.described))
        keyed, signals = self._table("keyed", version), self._table("signals", version)
        self._write(self.pairs().join(attributes, "entity_id", "left"), keyed, "keyed")
        learned = self.spark.table(keyed).filter("dim IS NOT NULL").groupBy(*BY_KEY).agg(F.sum("w").cast("double").alias("weight"))
        tops = learned.groupBy("user_id", "dim").agg(F.greatest(F.lit(1.0), F.max("weight")).alias("top"), F.count("weight").alias("known")).filter("known > 0")
        sums = self.pairs().groupBy("user_id").agg(F.sum("w").alias("total")).filter("total > 0")
        found = learned.join(tops, ["user_id", "dim"], "left").join(sums, "user_id", "left")
        signal = F.when(F.col("dim").isin(READ) & F.col("total").isNotNull(), F.coalesce("weight", F.lit(0.0)) / F.col("top"))
        self._write(found.select(*BY_KEY, "weight", signal.alias("signal")), signals, "signals")
        self.version = version
        self._note()

    def counters(self) -> DataFrame:
        """(user_id, dim, key, weight) as of the last learning; keys that were only shown have none."""
        return self.spark.table(self._table("signals", self.version)).filter("weight IS NOT NULL").select(*BY_KEY, "weight")

    def affinity(self) -> DataFrame:
        """(user_id, entity_id, affinity) of all pairs of the last learning, as preference.affinity defines it."""
        keyed, signals = (self.spark.table(self._table(k, self.version)) for k in ("keyed", "signals"))
        mean = keyed.join(signals.select(*BY_KEY, "signal"), list(BY_KEY), "left").groupBy("user_id", "entity_id").agg(F.avg("signal").alias("mean"))
        return mean.select("user_id", "entity_id", F.coalesce(clamp(F.col("mean")), F.lit(0.5)).alias("affinity"))
