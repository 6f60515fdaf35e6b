"""Streaming forms: conversation filters kept per session, and micro-batch upserts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from popgraph.operators.conversation import has_any
from popgraph.sources.files import scratch_path, upsert_latest


def carried_filters_stream(turns: DataFrame, extract: dict[str, Column], reset, idle: str | None = None) -> DataFrame:
    """Filters in force after each user turn of a message stream, the same as the batch form.

    Extraction runs in the JVM; the state of a session is its reset count and one value per filter.
    A session's messages of a batch are put in turn order before the state moves. With `idle` a
    session that stays silent that long is forgotten.
    """
    names = list(extract)
    text = F.col("text")
    rows = turns.where(F.col("role") == "user").select(
        "conv_id", "turn", has_any(text, reset).alias("is_reset"), *[c.alias(n) for n, c in extract.items()]
    )
    value_types = ", ".join(f"{n} string" for n in names)

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        epoch, *values = state.get if state.exists else (0, *[None] * len(names))
        out = []
        for row in pd.concat(list(batches)).sort_values("turn").itertuples(index=False):
            if row.is_reset:
                epoch, values = epoch + 1, [None] * len(names)
            else:
                found = [getattr(row, n) for n in names]
                values = [old if new is None or pd.isna(new) else new for new, old in zip(found, values)]
            out.append((key[0], row.turn, epoch, *values))
        state.update((epoch, *values))
        if idle:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=["conv_id", "turn", "epoch", *names])

    return rows.groupBy("conv_id").applyInPandasWithState(
        advance, f"conv_id long, turn long, epoch long, {value_types}", f"epoch long, {value_types}", "append",
        GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout,
    )


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over the data available now into a parquet folder and read the folder."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-progress")
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def upsert_stream(stream: DataFrame, key: str, shape: Callable[[DataFrame], DataFrame], schema: str, name: str) -> DataFrame:
    """Fold a stream into a keyed table and return the table after the last batch.

    `shape` turns a batch into rows of `schema`: the key, and per property a struct of event number and value. The newest
    event wins also when it came in an earlier batch. Every batch writes the folder of its own number from the folder before it, so a batch that is run
    again after a failure overwrites its own result and nothing else.
    """
    spark: SparkSession = stream.sparkSession
    path = scratch_path(spark, name)
    done = {"batch": -1}

    def apply(batch: DataFrame, number: int) -> None:
        old = spark.read.parquet(f"{path}/{number - 1}") if number > 0 else spark.createDataFrame([], schema)
        upsert_latest(old, shape(batch), key).write.mode("overwrite").parquet(f"{path}/{number}")
        done["batch"] = number

    stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{path}-progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/{done['batch']}") if done["batch"] >= 0 else spark.createDataFrame([], schema)
