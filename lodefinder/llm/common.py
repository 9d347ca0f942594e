"""What the text operators share: work folder, staged tables, row-wise Arrow maps.

Conventions that hold for every operator of this subpackage:

* a null text counts as an empty text, unless an operator says otherwise;
* repeated rows are rows of their own: each gets its own result row;
* ties are broken by the smaller identifier;
* an empty table gives an empty result with the same columns;
* columns that an operator does not read are ignored, whatever their names.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows of an Arrow batch; texts may be very long, so batches stay small.
BATCH_ROWS = 1000


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small, unless the session has a setting of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def work_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only where none is set (local tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lodefinder-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage in a way that survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(*tables: DataFrame) -> None:
    """Delete the files of tables that staged gave and that nothing reads any more, nor would if an executor were lost."""
    for table in tables:
        files, context = table._jdf.inputFiles(), table.sparkSession.sparkContext
        if len(files):  # one file's name comes to the driver's Python, not all
            folder = context._jvm.org.apache.hadoop.fs.Path(context._jvm.java.net.URI(files[0])).getParent()
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


#: What this worker keeps between its tasks: the object of the operator that it ran last.
_HELD: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], object]) -> object:
    """The object that make gives, kept in this worker until it is asked for another.

    Workers are used again by later stages; so the largest of their caches, not all together, bounds what they hold.
    """
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def fresh(name: str, taken) -> str:
    """name, or name with underscores before it until it differs from all taken names."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name = "_" + name
    return name


def map_text(docs: DataFrame, text_col: str, keep: list[str], fields: list[tuple[str, T.DataType]], start: Callable[[], Callable[[list], list]]) -> DataFrame:
    """The kept columns and, computed from the text of each row, the fields.

    start runs once in each task and returns a function from a list of texts (None for null) to one list for
    each field. Row order and partitioning stay as they are; there is no shuffle.
    """
    tune(docs.sparkSession)
    columns = list(dict.fromkeys([*keep, text_col]))
    narrow = docs.select(*columns)
    schema = T.StructType([narrow.schema[c] for c in keep] + [T.StructField(n, t) for n, t in fields])
    arrow_types = [to_arrow_type(t) for _, t in fields]
    names = [*keep, *(n for n, _ in fields)]
    at, kept_at = columns.index(text_col), [columns.index(c) for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = start()
        for batch in batches:
            made = compute(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in kept_at] + [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(made, arrow_types, strict=True)], names=names
            )

    return narrow.mapInArrow(run, schema)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
