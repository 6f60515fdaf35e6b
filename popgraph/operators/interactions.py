"""Train, validation and test interactions; train-only item profile; negatives and training triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from popgraph.functions.columns import row_count, shuffle_key, top_n
from popgraph.functions.skew import by_key, dense_index, hashed_row_number, join_measured, running_count
from popgraph.schema import PROFILE_FIELDS
from popgraph.session import cut_lineage


def split_by_person(
    edges: DataFrame, validation: float = 0.1, test: float = 0.1, min_eval: int = 3,
    two_items: str = "one_eval", seed: int = 42,
) -> DataFrame:
    """(uuid, item, split): each person's items in seeded order, first validation, then test, rest train.

    Ranks come bucket by bucket, so a person with a large share of all items is not one task.
    """
    ranked = hashed_row_number(
        edges.select("uuid", "item").distinct(), ["uuid"], shuffle_key("uuid", "item", seed=seed), "pos", total="n"
    )
    v = F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(validation))).cast("int")
    t = F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(test))).cast("int")
    hold = F.least(F.col("n") - 1, v + t)
    enough = F.col("n") >= min_eval
    two = F.lit(two_items == "one_eval") & (F.col("n") == 2) & ~enough
    n_val = F.when(enough, F.least(v, hold)).when(two, 1).otherwise(0)
    n_hold = F.when(enough, hold).when(two, 1).otherwise(0)
    split = F.when(F.col("pos") <= n_val, "validation").when(F.col("pos") <= n_hold, "test").otherwise("train")
    return ranked.select("uuid", "item", split.alias("split"))


def dense_ids(values: DataFrame, column: str, out: str) -> DataFrame:
    return dense_index(values.select(column).distinct(), [column], out)


def index_edges(edges: DataFrame) -> DataFrame:
    """Edges with dense person and item ids."""
    return edges.join(dense_ids(edges, "uuid", "person_id"), "uuid").join(dense_ids(edges, "item", "item_id"), "item").select(
        "uuid", "item", "person_id", "item_id"
    )


def popularity(train: DataFrame) -> DataFrame:
    return train.groupBy("item").agg(row_count("pop"))


def popularity_ranks(pop: DataFrame) -> DataFrame:
    """Items by popularity, then name, with their 1-based position; ranked range by range."""
    keyed = pop.withColumn("__neg", -F.col("pop"))
    return dense_index(keyed, ["__neg", "item"], "pos").select("item", "pop", (F.col("pos") + 1).cast("int").alias("pop_rank"))


CHUNK = 64


def cooccurrence(train: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Persons per ordered pair of different items: (src, dst, c).

    A person's items are cut into chunks by a hash; chunk meets chunk, never a whole person at once,
    so a person with very many items is spread over many tasks. Pairs are counted in each task
    before the shuffle, which then moves at most one row per item pair and task.
    """
    sizes = train.groupBy("uuid").agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).cast("int").alias("n_chunks"))
    rows = train.select("uuid", "item").join(sizes, "uuid").withColumn(
        "chunk", F.pmod(F.xxhash64("item"), F.col("n_chunks")).cast("int")
    )
    lists = rows.groupBy("uuid", "n_chunks", "chunk").agg(F.collect_list("item").alias("items"))
    left = lists.select("uuid", F.col("items").alias("a"), "chunk", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("other"))
    right = lists.select("uuid", F.col("items").alias("b"), F.col("chunk").alias("other"))
    met = by_key(left, "uuid", "other").join(by_key(right, "uuid", "other"), ["uuid", "other"])
    pairs = met.select(F.explode("a").alias("src"), "b").select("src", F.explode("b").alias("dst"))
    return pairs.where(F.col("src") != F.col("dst")).groupBy("src", "dst").agg(row_count("c"))


def field_values(contexts: DataFrame, fields: list[str] = PROFILE_FIELDS) -> DataFrame:
    """(uuid, field, value) of the non-blank demographic columns."""
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.trim(F.col(f)).alias("value")) for f in fields])
    return contexts.select(F.col("person_uuid").alias("uuid"), F.explode(entries).alias("e")).select(
        "uuid", "e.field", "e.value"
    ).where(F.col("value") != "")


def field_histogram(train: DataFrame, contexts: DataFrame) -> DataFrame:
    """Per item and demographic value: train persons and their share within the item's field.

    Contexts are joined once per edge and unpivoted afterwards, so the shuffle moves one row per edge.
    """
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.trim(F.col(f)).alias("value")) for f in PROFILE_FIELDS])
    rows = train.select("uuid", "item").join(contexts.select(F.col("person_uuid").alias("uuid"), *PROFILE_FIELDS), "uuid")
    counts = (
        rows.select("item", F.explode(entries).alias("e")).select("item", "e.field", "e.value")
        .where(F.col("value") != "").groupBy("item", "field", "value").agg(row_count())
    )
    return counts.withColumn("share", F.col("cnt") / F.sum("cnt").over(Window.partitionBy("item", "field")))


def top_cooccurring(cooc: DataFrame, n: int = 20) -> DataFrame:
    return top_n(cooc, ["src"], [F.desc("c"), F.asc("dst")], n)


def require_train_only(df: DataFrame) -> DataFrame:
    """Fail when a profile is about to be built from held-out rows."""
    if "split" in df.columns and not df.where(F.col("split") != "train").isEmpty():
        raise ValueError("item profile must be generated from train split only")
    return df


def known_lists(known: DataFrame) -> DataFrame:
    """Each person's known items as one array; it cannot exceed the item catalogue."""
    return known.groupBy("uuid").agg(F.collect_set("item").alias("known"))


ID_BLOCK = 4096


def sample_negative(positives: DataFrame, full_known: DataFrame, items: DataFrame, seed: int = 42) -> DataFrame:
    """One item outside the person's known set for every positive, uniform by hash.

    A person with m known items of n draws r among its n-m unknown ones. The unknown item at position r
    has id r plus the number of known items before it, and the i-th known id k (from 0) lies before it
    exactly when k - i <= r. Both counts are running counts over id blocks, so no person meets the
    whole catalogue and no list of known items is built.
    """
    ids = cut_lineage(dense_ids(items, "item", "item_id"))
    n = ids.count()
    known = cut_lineage(join_measured(full_known.select("uuid", "item").distinct(), ids, "item", "uuid").select("uuid", "item_id"))
    sizes = known.groupBy("uuid").agg(row_count("m"))
    if not sizes.where(F.col("m") >= n).isEmpty():
        raise ValueError("a person is connected to every item; cannot sample a negative")
    placed = running_count(known.withColumn("one", F.lit(1)), ["uuid"], "item_id", "one", ID_BLOCK, "i")
    shifted = placed.select("uuid", (F.col("item_id") - (F.col("i") - 1)).alias("at"), F.lit(1).alias("one"), F.lit(None).cast("string").alias("item"))
    draw = F.conv(F.substring(shuffle_key("uuid", "item", seed=seed), 1, 12), 16, 10).cast("long")
    drawn = positives.select("uuid", "item").join(sizes, "uuid").select(
        "uuid", F.pmod(draw, F.lit(n) - F.col("m")).alias("at"), F.lit(0).alias("one"), "item"
    )
    counted = running_count(shifted.unionByName(drawn), ["uuid"], "at", "one", ID_BLOCK, "before")
    rows = counted.where(F.col("item").isNotNull()).select("uuid", "item", (F.col("at") + F.col("before")).alias("item_id"))
    return join_measured(rows, ids.withColumnRenamed("item", "negative"), "item_id", "uuid").select("uuid", "item", "negative")


def training_triples(triples: DataFrame, batch_size: int, seed: int = 42) -> DataFrame:
    """Triples in seeded order with their batch number."""
    keyed = triples.withColumn("__h", shuffle_key("uuid", "item", seed=seed + 1))
    return dense_index(keyed, ["__h"], "pos").withColumn("batch", F.floor(F.col("pos") / batch_size)).drop("__h")


def demographic_key(field: str, value: Column) -> Column:
    return F.concat(F.lit(f"{field}="), value)
