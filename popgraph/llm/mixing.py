"""Mixing sources to target weights: packed blocks, multinomial shard counts, index permutations.

1. `source_targets`: every source's target in words, with repeats up to a limit.
2. `pack`: a source's texts, in the order of their ids, form one stream of words, cut into blocks of
   BLOCK_WORDS; a block is a list of segments (document, first word, number of words).
3. `slots`: every output shard draws how many blocks each source gives it (multinomial over what the
   sources still have to give, so that the totals are exact); slot j of a source is its block
   permutation(j mod blocks), with another permutation in every pass over the source.
4. `mix`: slots and segments meet on (source, block).

A source that holds most rows is no hot key: running word counts are taken inside range partitions and
shifted by the totals of earlier ones; slots and segments are keyed by block. The driver holds one
number per source and shard (SHARDS is fixed), never rows.

Defined cases: null text has no words, is packed nowhere and taken 0 times; the null source is a
source, last in order; documents with equal ids go by source, then text hash; repeated rows are
documents of their own; an empty table, or one without words, gives no slots; other columns are
ignored by `mix`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from popgraph.llm.common import WORD, kept, let, numbered, spread_count, words

BLOCK_WORDS = 64
SHARDS = 64
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_REPEATS = 2.0
SEED = 17
CHUNK = 4096


def text_words(text: str = "text"):
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """(source, source_size, weight, target) from (source, size) rows.

    Sources by code point, null last, take `weights` in turn. `share` of all words is dealt by weight; a
    target stops at `max_repeats` times its source's size and what is over is dealt again by weight
    among the others, until no target is above.
    """
    totals = kept(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    order = Window.orderBy(F.col("source").isNull(), "source")  # one row per source
    ranked = totals.withColumn("__i", F.row_number().over(order) - 1)
    cycle = F.array(*map(F.lit, map(float, weights)))
    ranked = kept(ranked.withColumn("weight", F.get(cycle, F.col("__i") % len(weights))).drop("__i"), "sources")
    limit = F.col("source_size") * max_repeats
    level, above = None, -1
    while True:
        over = F.lit(False) if level is None else limit < F.col("weight") * level
        sums = ranked.agg(
            F.sum("source_size").alias("words"), F.sum(F.when(over, limit).otherwise(0.0)).alias("fixed"),
            F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("open"), F.count(F.when(over, 1)).alias("n"),
        ).first()
        if sums["n"] == above or not sums["open"]:
            break
        above = sums["n"]
        level = (min(share, max_repeats) * sums["words"] - sums["fixed"]) / sums["open"]
    return ranked.withColumn("target", F.least(F.col("weight") * F.lit(level), limit))


def sized(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """(source, doc_id, __row, size, __h) of every document, written once: texts are read and their words counted here only."""
    rows = numbered(docs).select(
        F.col(source).alias("source"), F.col(doc_id).alias("doc_id"), "__row", text_words(text).alias("size"),
        F.xxhash64(F.col(text)).alias("__h"),
    )
    return kept(rows, "sizes")


def pack(
    docs: DataFrame, block_words: int = BLOCK_WORDS, text: str = "text", source: str = "source", doc_id: str = "doc_id",
    sizes: DataFrame | None = None,
) -> DataFrame:
    """(source, block, doc_id, row, first_word, n_words, size, in_block) segments, without their text.

    `docs` must be a table, `sizes` its `sized`, if known. A document without words gives no segment.
    """
    rows = sized(docs, text, source, doc_id) if sizes is None else sizes
    ranged = rows.where("size > 0").repartitionByRange(F.col("source").isNull(), "source", "doc_id", "__h", "__row")
    ranged = kept(ranged.withColumn("__part", F.spark_partition_id()), "packed")
    key = [F.col("source").isNull(), F.col("source")]
    own = ranged.groupBy("__part", "source").agg(F.sum("size").alias("__n"))
    before = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = own.select("__part", F.col("source").alias("__s"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__part", *key).orderBy("doc_id", "__h", "__row").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("__in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(starts, (placed["__part"] == starts["__part"]) & placed["source"].eqNullSafe(starts["__s"])).select(
        "source", "doc_id", F.col("__row").alias("row"), "size", (F.col("__in") + F.col("__base")).alias("__at")
    )
    b = F.lit(block_words)
    end = F.col("__at") + F.col("size")
    cut = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("__at") / b), F.floor((end - 1) / b))))
    first = F.greatest(F.col("block") * b, F.col("__at"))
    last = F.least((F.col("block") + 1) * b, end)
    return cut.select(
        "source", "block", "doc_id", "row", "size", (first - F.col("block") * b).cast("int").alias("in_block"),
        (first - F.col("__at")).cast("int").alias("first_word"), (last - first).cast("int").alias("n_words"),
    )


def draw_counts(slots: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks per shard and source: multinomial draws over what is left of every source's slots."""
    left = np.array(slots, dtype=np.int64)
    out = np.zeros((shards, len(left)), dtype=np.int64)
    rng = np.random.default_rng(seed)
    for shard in range(shards):
        size = -(-int(left.sum()) // (shards - shard))
        while size:
            drawn = np.minimum(rng.multinomial(size, left / left.sum()), left)
            out[shard] += drawn
            left -= drawn
            size -= int(drawn.sum())
    return out


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of range(size) for each key, at `index`: a 4-round Feistel network
    over the next even number of bits, walked until it lands in range."""
    bits = np.maximum(1, np.ceil(np.ceil(np.log2(np.maximum(size, 2))) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    key, size = key.astype(np.uint64), size.astype(np.uint64)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    with np.errstate(over="ignore"):
        while len(todo):
            x, b, m, k = out[todo], bits[todo], mask[todo], key[todo]
            left, right = x >> b, x & m
            for turn in range(4):
                h = (right + k + np.uint64(turn + 1) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((h >> np.uint64(32)) & m)
            out[todo] = (left << b) | right
            todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def slots(spark, plan: list[tuple], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(shard, source, slot, block) from `plan`, a list of (source, number of blocks, number of slots)."""
    counts = draw_counts([p[2] for p in plan], shards, seed) if plan else np.zeros((0, 0), dtype=np.int64)
    first = np.cumsum(counts, axis=0) - counts if plan else counts
    rows = [
        (shard, source, n_blocks, int.from_bytes(hashlib.sha256(f"{seed}/{source!r}".encode()).digest()[:7], "big"), int(first[shard, i]), int(counts[shard, i]))
        for shard in range(len(counts)) for i, (source, n_blocks, _) in enumerate(plan) if counts[shard, i]
    ]
    table = spark.createDataFrame(rows, "shard int, source string, n_blocks bigint, key bigint, first bigint, n bigint")
    chunks = table.withColumn("__c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))))
    chunks = chunks.repartition(spread_count(spark))
    each = chunks.withColumn(
        "slot", F.explode(F.sequence(F.col("first") + F.col("__c"), F.col("first") + F.least(F.col("__c") + CHUNK, F.col("n")) - 1))
    )

    @F.pandas_udf(T.LongType())
    def block(slot: pd.Series, n_blocks: pd.Series, key: pd.Series) -> pd.Series:
        j, n = slot.to_numpy(), n_blocks.to_numpy()
        return pd.Series(permute(j % n, n, key.to_numpy() + (j // n) * 7919))

    return each.select("shard", "source", "slot", block("slot", "n_blocks", "key").alias("block"))


def mix(
    docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeats: float = MAX_REPEATS, block_words: int = BLOCK_WORDS,
    shards: int = SHARDS, seed: int = SEED, text: str = "text", source: str = "source", doc_id: str = "doc_id",
    sizes: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The mix and its targets.

    The mix has a row per slot and segment: (shard, source, slot, block, in_block, doc_id, row, first_word,
    n_words); `materialise` adds the words. Read in the order of shard, source, slot, in_block it is the
    packed data. Targets are those of `source_targets`. `docs` must be a table, `sizes` its `sized`, if known.
    """
    spark = docs.sparkSession
    sizes = sized(docs, text, source, doc_id) if sizes is None else sizes
    segments = kept(pack(docs, block_words, text, source, doc_id, sizes), "segments")
    targets = kept(source_targets(sizes.select("source", "size"), weights, share, max_repeats), "targets")
    plan = [
        (r.source, n, min(round(r.target * n / r.source_size), int(max_repeats * n)))
        for r in targets.where("source_size > 0").orderBy(F.col("source").isNull(), "source").toLocalIterator()
        for n in [-(-r.source_size // block_words)]
    ]
    taken = slots(spark, plan, shards, seed)
    own = segments.withColumnsRenamed({"source": "__source", "block": "__block"})
    # both sides grow with the words; the planner takes the slots, made from a short list, for a small table
    met = taken.join(own.hint("merge"), taken["source"].eqNullSafe(own["__source"]) & (taken["block"] == own["__block"]))
    return met.drop("__source", "__block", "size"), targets


def materialise(mixed: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows of `mix` with their words, joined by spaces, as `text`. `docs` is the same table."""
    rest = [c for c in mixed.columns if c != "row"]
    cuts = mixed.groupBy("row").agg(F.collect_list(F.struct(*rest)).alias("__cuts"))
    texts = numbered(docs).select(F.col("__row").alias("row"), F.col(text).alias("__text"))
    met = texts.join(cuts, "row").select(words(F.col("__text")).alias("__words"), "__cuts")
    each = met.select(F.explode(let(F.col("__words"), lambda w: F.transform("__cuts", lambda c: F.struct(
        *(c[k].alias(k) for k in rest), F.array_join(F.slice(w, c["first_word"] + 1, c["n_words"]), " ").alias("text")
    )))).alias("s"))
    return each.select("s.*")
