"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from popgraph.session import tune
from popgraph.sources.files import scratch_path

SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
BATCH_ROWS = 1000
FILE_ROWS_BITS = 40


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the text operators: small Arrow batches, as one text may be megabytes long."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write to the cluster's shared folder and read back: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame) -> DataFrame:
    """Add `__row`, a number per row: place of its file among the table's files, then place in the file.

    `docs` must be a table of Parquet files (also `kept`). The numbers do not depend on how an action splits the files,
    so every action gives a row the same one. Rows that lie in no file are numbered by partition.
    """
    if not docs.inputFiles():
        return docs.withColumn("__row", F.monotonically_increasing_id())
    own = docs.metadataColumn("_metadata")
    files = sorted(r[0] for r in docs.select(own["file_path"]).distinct().collect())
    rows = docs.withColumns({"__file": own["file_path"], "__row": own["row_index"]})
    if len(files) > 1:
        first = [(path, i << FILE_ROWS_BITS) for i, path in enumerate(files)]
        places = docs.sparkSession.createDataFrame(first, "__file string, __first bigint")
        rows = rows.join(F.broadcast(places), "__file").withColumn("__row", F.col("__first") + F.col("__row")).drop("__first")
    return rows.drop("__file")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once per row, also when lambdas inside `body` use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Array of the words of a text (null: none)."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\v\f\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+"))


def lower_words(text: Column) -> Column:
    """As `words`, in lower case."""
    return words(F.lower(text))


def spread_count(spark: SparkSession) -> int:
    """Partitions for rows that a following step multiplies."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def annotate(
    docs: DataFrame, fields: list[tuple[str, T.DataType]], fn: Callable[[pa.RecordBatch], list[pa.Array]],
    hide: tuple[str, ...] = (),
) -> DataFrame:
    """Rows (doc, *fields): every row of `docs` as a struct, next to what `fn` computes for its batch.

    The struct keeps columns of `docs` apart from the results, whatever they are called. Columns in
    `hide` are read by `fn` and not returned.
    """
    shown = [f for f in docs.schema.fields if f.name not in hide]
    schema = T.StructType([T.StructField("doc", T.StructType(shown)), *(T.StructField(n, t) for n, t in fields)])
    names, own = ["doc", *(n for n, _ in fields)], [f.name for f in shown]

    def run(batches):
        for batch in batches:
            doc = pa.StructArray.from_arrays([batch.column(n) for n in own], names=own)
            yield pa.RecordBatch.from_arrays([doc, *fn(batch)], names=names)

    return docs.mapInArrow(run, schema)
