"""Language-model scoring by context-tree weighting.

Bytes are coded as eight binary decisions; a decision is a node of the current byte's bit prefix, and its
context is the bytes before, up to `depth` of them. For every context and every bit prefix the corpus gives
counts of zeros and ones, a Krichevsky-Trofimov estimate of their probability, and the weighted
probability: half the node's own estimate, half the product over its longer contexts. The model's
probability of a decision mixes the estimates of all depths along the context, weighted by that evidence.

A code is a byte and its context. Texts are cut into buckets of bounded size; a task keeps the different codes of one
bucket, with their number in training texts. Codes meet by their two nearest context bytes (shards): there the whole
subtree is weighted, upwards for the depths below two, which Spark sums over all shards, then downwards, which gives
every code its probability. These go back to the bucket, where its texts are scored. The model grows with the corpus;
no task holds more than a shard or a bucket of it, and only the depths of no and one byte (256 x 256 numbers) go to all.

Beside the model stands a unigram score over words. Counts of the commonest words (TOP_WORDS at most) are
broadcast; all other words of a document meet their counts in a join by word, which holds no hot word then.

A text starts in the context of end marks and ends with one (byte 255, which UTF-8 never has).

Defined cases: null text is empty and scored as the end mark alone; a null id counts as an empty string;
texts are scored whole, long ones piece by piece; repeated rows are texts of their own; a corpus
without training texts gives every byte 1/256 and every word an equal share; an empty table gives an empty
result; other columns stay apart in `doc`.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from popgraph.llm.common import kept, numbered
from popgraph.session import dropping_shuffles

SYMBOLS = 256
DEPTH = 5  # bytes of context that the registered query looks back
MAX_DEPTH = 6  # a code is one 64-bit number
TOP_WORDS = 200_000
PIECE = 1 << 22
BUCKET_BYTES = 16 << 20
FLUSH_CODES = 1 << 22
FLUSH_WORDS = 300_000
FOLDS = 10
PACK_SCHEMA = "bucket bigint, shard int, codes binary, n binary"
SCORED_SCHEMA = "bucket bigint, codes binary, p binary"
NODE_SCHEMA = "c2 int, c1 int, node int, zeros bigint, ones bigint, weighted double"


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def data(value) -> bytes:
    """The text's bytes, A-Z in lower case."""
    text = value.as_py()
    return text.encode().lower() if text else b""


def codes(raw: bytes, depth: int):
    """Byte and context as one number for every byte and the end mark, piece by piece: the nearest byte comes first, the byte itself last."""
    padded = np.frombuffer(b"\xff" * depth + raw + b"\xff", dtype=np.uint8)
    for at in range(0, len(padded) - depth, PIECE):
        part = padded[at : at + PIECE + depth].astype(np.int64)
        n = len(part) - depth
        code = part[depth:].copy()
        for back in range(1, depth + 1):
            code |= part[depth - back : depth - back + n] << (8 * (depth - back + 1))
        yield code


def _squeezed(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes, first bytes first; ascending codes as their differences."""
    if values.dtype == np.int64:
        values = np.diff(values, prepend=0)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return planes.nbytes.to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def _opened(scalar: pa.BinaryScalar, dtype: type) -> np.ndarray:
    raw = scalar.as_buffer()
    size, width = int.from_bytes(raw[:8].to_pybytes(), "little"), np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.Codec("zstd").decompress(raw[8:], size), np.uint8).reshape(width, -1)
    values = np.ascontiguousarray(planes.T).view(dtype).ravel()
    return np.cumsum(values) if dtype == np.int64 else values


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sum of their counts."""
    key, n = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(n[order], first)


def packs(rows: DataFrame, shards: int, depth: int) -> DataFrame:
    """The different codes of the texts of (bucket, held, text) per bucket and shard, and their number in training texts.

    Rows of a bucket that lie in several tasks, or have very many codes, give several packs.
    """

    def packed(bucket: int, train: list, held: list):
        parts = [np.unique(np.concatenate(x), return_counts=True) for x in (train, held) if x]
        if held:
            parts[-1][1][:] = 0
        code, n = _merged([k for k, _ in parts], [c for _, c in parts])
        pair = (code >> (8 * (depth - 1))).astype(np.uint64)
        shard = ((pair * np.uint64(2654435761) % np.uint64(1 << 32)) >> np.uint64(8)) % np.uint64(shards)
        order = np.argsort(shard, kind="stable")
        shard, code, n = shard[order], code[order], n[order]
        cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
        for a, b in zip(cuts, np.append(cuts[1:], len(code))):
            values = [[bucket], [int(shard[a])], [_squeezed(code[a:b])], [_squeezed(n[a:b].astype(np.int32))]]
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=["bucket", "shard", "codes", "n"])

    def collect(batches):
        now, kinds, held = None, ([], []), 0
        for batch in batches:
            for bucket, is_held, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if now is not None and (bucket != now or held > FLUSH_CODES):
                    yield from packed(now, *kinds)
                    kinds, held = ([], []), 0
                now = bucket
                for code in codes(data(value), depth):
                    kinds[is_held].append(code)
                    held += len(code)
        if now is not None:
            yield from packed(now, *kinds)

    return rows.mapInArrow(collect, PACK_SCHEMA)


@F.pandas_udf(T.DoubleType())
def log_kt(zeros: pd.Series, ones: pd.Series) -> pd.Series:
    """Natural logarithm of the Krichevsky-Trofimov probability of so many zeros and ones."""
    gamma = math.lgamma
    return pd.Series([gamma(a + 0.5) + gamma(b + 0.5) - gamma(a + b + 1) - math.log(math.pi) for a, b in zip(zeros, ones)], dtype="float64")


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """As `log_kt`; every different number is worked out once."""

    def log_gamma(values, more):
        different, at = np.unique(values, return_inverse=True)
        return np.array([math.lgamma(x + more) for x in different.tolist()])[at]

    return log_gamma(zeros, 0.5) + log_gamma(ones, 0.5) - log_gamma(zeros + ones, 1) - math.log(math.pi)


class _Level:
    """Nodes of one depth: `ids` (context * 256 + node) in order, zeros, ones, and what the weighting adds."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        ids, zeros, ones = [], [], []
        for k in range(8):
            group = keys >> (8 - k)
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            one = np.add.reduceat(n * ((keys >> (7 - k)) & 1), first)
            group = group[first]
            ids.append(((group >> k) << 8) | (1 << k) | (group & ((1 << k) - 1)))
            zeros.append(np.add.reduceat(n, first) - one)
            ones.append(one)
        self.ids = np.concatenate(ids)
        order = np.argsort(self.ids)
        self.ids, self.zeros, self.ones = self.ids[order], np.concatenate(zeros)[order], np.concatenate(ones)[order]
        self.weighted, self.beta = _log_kt(self.zeros, self.ones), None

    def estimate(self) -> np.ndarray:
        return (self.ones + 0.5) / (self.zeros + self.ones + 1.0)

    def parents(self, above: "_Level") -> np.ndarray:
        """Places of the same nodes with one context byte less."""
        return np.searchsorted(above.ids, ((self.ids >> 16) << 8) | (self.ids & 255))

    def weigh(self, longer: "_Level") -> None:
        below = np.bincount(longer.parents(self), weights=longer.weighted, minlength=len(self.ids))
        own = self.weighted
        self.beta = np.exp(np.minimum(own - below, 700.0))
        self.weighted = np.maximum(own, below) + np.log1p(np.exp(-np.abs(own - below))) - math.log(2)


def _levels(keys: np.ndarray, n: np.ndarray, depth: int) -> list[_Level]:
    """Levels of depth two to `depth` of whole subtrees, weighted."""
    levels = [_Level(keys, n)]
    for _ in range(depth - 2):
        keys, n = _merged([((keys >> 16) << 8) | (keys & 255)], [n])
        levels.append(_Level(keys, n))
        levels[-1].weigh(levels[-2])
    return levels[::-1]


def _shard(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The codes of every pack, all different codes and their numbers."""
    held = [_opened(x, np.int64) for x in table.column("codes")]
    return held, *_merged(held, [_opened(x, np.int32) for x in table.column("n")])


def tree(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with one and no context bytes, (c1, node, zeros, ones, beta), from those with two.

    `beta` is the odds of the node's own estimate against the product of its longer contexts.
    """

    def above(nodes: DataFrame, *keys: str) -> DataFrame:
        sums = nodes.groupBy(*keys, "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("below"))
        own = sums.withColumn("own", log_kt("zeros", "ones"))
        more, less = F.greatest("own", "below"), F.least("own", "below")
        return own.select(
            *keys, "node", "zeros", "ones", F.exp(F.least(F.col("own") - F.col("below"), F.lit(700.0))).alias("beta"),
            (more + F.log1p(F.exp(less - more)) - math.log(2)).alias("weighted"),
        )

    middle = kept(above(leaves, "c1"), "contexts")
    return middle, above(middle)


def model(packed: DataFrame, shards: int, depth: int) -> DataFrame:
    """(bucket, codes, p): log10 probability of every code of every pack."""
    dealt = packed.repartition(shards, "shard").groupBy("shard")

    def up(table: pa.Table) -> pa.Table:
        _, keys, n = _shard(table)
        top = _levels(keys, n, depth)[0]
        columns = [(top.ids >> 8) & 255, top.ids >> 16, top.ids & 255]
        return pa.table([*(pa.array(c.astype(np.int32)) for c in columns), top.zeros, top.ones, top.weighted], names=["c2", "c1", "node", "zeros", "ones", "weighted"])

    middle, top = (x.toPandas() for x in tree(kept(dealt.applyInArrow(up, NODE_SCHEMA), "contexts")))  # 65,280 and 255 nodes at most

    def spread(frame: pd.DataFrame, shape: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Share of the node's own estimate in the mix, and that share times the estimate; unseen nodes have a half."""
        share, own = np.full(shape, 0.5), np.full(shape, 0.25)
        at = tuple(frame[c].to_numpy(dtype=np.int64) for c in (["c1", "node"] if len(shape) == 2 else ["node"]))
        zeros, ones, beta = (frame[c].to_numpy(dtype=np.float64) for c in ("zeros", "ones", "beta"))
        share[at] = beta / (beta + 1)
        own[at] = share[at] * (ones + 0.5) / (zeros + ones + 1)
        return share, own

    share0, own0 = spread(top, (SYMBOLS,))
    share1, own1 = spread(middle, (SYMBOLS, SYMBOLS))
    fixed = own0 + (1 - share0) * own1  # what the two upper depths give, by byte before and node
    left = (1 - share0) * (1 - share1)  # and the share of all deeper ones

    def down(table: pa.Table) -> pa.Table:
        held, keys, n = _shard(table)
        levels = _levels(keys, n, depth)
        at = (levels[0].ids >> 16, levels[0].ids & 255)
        p, rest = fixed[at], left[at]
        for above, level in zip(levels, levels[1:]):
            share = above.beta / (above.beta + 1)
            p, rest = p + rest * share * above.estimate(), rest * (1 - share)
            place = level.parents(above)
            p, rest = p[place], rest[place]
        p = np.clip(p + rest * levels[-1].estimate(), 1e-300, 1 - 1e-16)
        total = np.zeros(len(keys))
        for k in range(8):
            node = ((keys >> 8) << 8) | (1 << k) | ((keys & 255) >> (8 - k))
            one = p[np.searchsorted(levels[-1].ids, node)]
            total += np.log10(np.where((keys >> (7 - k)) & 1, one, 1 - one))
        found = [_squeezed(total[np.searchsorted(keys, code)].astype(np.float32)) for code in held]
        return pa.table([table.column("bucket"), table.column("codes"), pa.array(found, pa.binary())], names=["bucket", "codes", "p"])

    return dealt.applyInArrow(down, SCORED_SCHEMA)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts of a one-column table; the empty word is the end of a text."""

    def count(batches):
        found: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                found.update(data(value).split())
                found[b""] += 1
                if len(found) > FLUSH_WORDS:
                    yield from _word_batches(found)
                    found = Counter()
        yield from _word_batches(found)

    return texts.mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _word_batches(found: Counter):
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])


def common_words(counts: DataFrame, most: int) -> dict[bytes, int]:
    """The commonest words, at most `most`: all above the count that gives no more."""
    level, words = None, 0
    for row in counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).toLocalIterator():
        words += row["words"]
        if words > most:
            break
        level = row["n"]
    if level is None:
        return {}
    top = counts.where(F.col("n") >= level).toPandas()
    return dict(zip(map(bytes, top["word"]), map(int, top["n"])))


def score(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", top_words: int = TOP_WORDS, carry: list[str] | None = None, depth: int = 2
) -> DataFrame:
    """(doc, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row.

    `docs` must be a table; `doc` has its columns `carry` (default: all). `score` is the model's log10
    probability of the text's bytes and its end, from contexts of up to `depth` bytes (two at least).
    """
    if not 2 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be from 2 to {MAX_DEPTH}")
    spark = docs.sparkSession
    rows = numbered(docs).withColumn("__held", held_out(F.col(doc_id)))
    train = rows.where(~F.col("__held")).select(text)
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes")).first()
    shards = max(spark.sparkContext.defaultParallelism, math.ceil(total["bytes"] / BUCKET_BYTES))
    bucket = F.floor(F.col("__row") / max(1, math.ceil(total["n"] / shards))).cast("long")
    packed = kept(packs(rows.select(bucket.alias("bucket"), "__held", text), shards, depth), "codes")
    with dropping_shuffles(spark):
        probabilities = model(packed, shards, depth)
        counts = kept(word_counts(train), "words")
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    train_tokens, below = sums["n"], sums["n"] + 0.1 * (sums["v"] + 1)
    common = spark.sparkContext.broadcast(common_words(counts, top_words))

    own = rows.select(bucket.alias("bucket"), "__row", F.col("__held").alias("held_out"), F.struct(*(carry or docs.columns)).alias("doc"), F.col(text).alias("__text"))
    long, double = T.LongType(), T.DoubleType()
    fields = [("n_tokens", long), ("top_known", long), ("top_base", double), ("score", double), ("bits_per_byte", double)]
    shown = [f for f in own.schema.fields if f.name in ("__row", "held_out", "doc")]

    def summed(texts: list[bytes], scored: pa.Table) -> np.ndarray:
        """Log10 probability of every text; codes are looked up in their order, FLUSH_CODES and a piece at a time."""
        code, p = (np.concatenate([_opened(x, kind) for x in scored.column(c)]) for c, kind in (("codes", np.int64), ("p", np.float32)))
        order = np.argsort(code)
        code, p, totals = code[order], p[order].astype(np.float64), np.zeros(len(texts))
        held, of, n = [], [], 0

        def add():
            different, at = np.unique(np.concatenate(held), return_inverse=True)
            starts = np.cumsum([0] + [len(x) for x in held[:-1]])
            np.add.at(totals, of, np.add.reduceat(p[np.searchsorted(code, different)][at], starts))

        for i, raw in enumerate(texts):
            for part in codes(raw, depth):
                held.append(part)
                of.append(i)
                n += len(part)
                if n > FLUSH_CODES:
                    add()
                    held, of, n = [], [], 0
        if held:
            add()
        return totals

    def measure(texts: pa.Table, scored: pa.Table) -> pa.Table:
        known, out = common.value, []
        raws = [data(value) for value in texts.column("__text")]
        for raw, total in zip(raws, summed(raws, scored).tolist() if raws else []):
            tokens = Counter(raw.split())
            tokens[b""] = 1
            base, seen = 0.0, 0
            for word, n in tokens.items():
                c = known.get(word)
                if c:
                    base += n * math.log10((c + 0.1) / below)
                    seen += n
            out.append((sum(tokens.values()), seen, base, total, -total / math.log10(2) / (len(raw) + 1)))
        columns = zip(*out) if out else [()] * 5
        types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        return pa.table([*(texts.column(f.name) for f in shown), *(pa.array(c, t) for c, t in zip(columns, types))], names=[*(f.name for f in shown), *(n for n, _ in fields)])

    both = (x.repartition(shards, "bucket").groupBy("bucket") for x in (own, probabilities))
    measured = next(both).cogroup(next(both)).applyInArrow(measure, T.StructType([*shown, *(T.StructField(n, t) for n, t in fields)]))

    def rare(batches):
        known = common.value
        for batch in batches:
            at, words, ns = [], [], []
            for row, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word, n in Counter(data(value).split()).items():
                    if word not in known:
                        at.append(row)
                        words.append(word)
                        ns.append(n)
                if b"" not in known:
                    at.append(row)
                    words.append(b"")
                    ns.append(1)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(words, pa.binary()), pa.array(ns, pa.int64())], names=["row", "word", "k"])

    tail = rows.select("__row", text).mapInArrow(rare, "row bigint, word binary, k bigint").join(counts, "word", "left")
    c = F.coalesce("n", F.lit(0))
    tail = tail.groupBy("row").agg(
        F.sum(F.col("k") * F.log10((c + 0.1) / F.lit(below))).alias("rest"), F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("rest_known")
    )
    met = measured.join(tail, measured["__row"] == tail["row"], "left")
    return met.select(
        "doc", "held_out", "n_tokens", (F.col("top_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"), (F.col("top_base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
        "score", "bits_per_byte",
    )
