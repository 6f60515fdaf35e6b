"""Benchmark decontamination: Wu-Manber search for windows of benchmark words in documents.

Texts are lower-cased (A-Z) and cut into words. Every run of WINDOW words of an item is a pattern; an item
of fewer words is one shorter pattern. Patterns of one length m make a searcher: a SHIFT table over
blocks of words says how far the search may skip, a bucket of the block that ends a pattern selects
patterns by their first block, and word-by-word comparison confirms.

The patterns are broadcast in blocks of at most BLOCK_WORDS words; with more items the documents pass
through one search per block, each in place, without a shuffle.

Defined cases: null text has no words; texts and items without words meet nothing; several items
with the same window all count; repeated items of one id count once; null item ids are ignored; an empty
document or item table is fine; other columns stay apart in `doc`.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from popgraph.llm.common import annotate

WINDOW = 13
BLOCK = 3
BLOCK_WORDS = 500_000
SHARE = 20  # contaminated: a hit word among at most this many words

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def split_words(text: str | None) -> list[str]:
    if not text:
        return []
    return _WORD.findall(text.lower() if text.isascii() else text.translate(_LOWER))


class Searcher:
    """Wu-Manber tables over patterns of exactly `m` words."""

    def __init__(self, patterns: dict[tuple[str, ...], set[str]], m: int, block: int):
        self.m, self.block = m, min(m, block)
        self.shift: dict[tuple[str, ...], int] = {}
        self.buckets: dict[tuple[str, ...], dict[tuple[str, ...], list[tuple]]] = defaultdict(lambda: defaultdict(list))
        b = self.block
        for pattern, ids in patterns.items():
            for end in range(b, m + 1):
                key = pattern[end - b : end]
                self.shift[key] = min(self.shift.get(key, m), m - end)
            self.buckets[pattern[-b:]][pattern[:b]].append((pattern, ids))

    def search(self, words: tuple[str, ...], hit: list[tuple[int, int]], items: set[str]) -> None:
        """Add (start, end) of occurrences and the ids of their items."""
        m, b, n, get = self.m, self.block, len(words), self.shift.get
        skip, end = m - b + 1, m
        while end <= n:
            block = words[end - b : end]
            shift = get(block, skip)
            if shift:
                end += shift
                continue
            start = end - m
            for pattern, ids in self.buckets[block].get(words[start : start + b], ()):
                if words[start:end] == pattern:
                    hit.append((start, end))
                    items |= ids
            end += 1


def searchers(rows: list[tuple[str, str]], window: int, block: int) -> list[Searcher]:
    by_length: dict[int, dict[tuple[str, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
    for item, text in rows:
        words = tuple(split_words(text))
        m = min(window, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            by_length[m][words[i : i + m]].add(item)
    return [Searcher(patterns, m, block) for m, patterns in sorted(by_length.items())]


def _item_blocks(items: DataFrame, item_id: str, text: str, block_words: int):
    """Items in blocks of bounded size, one block at a time on the driver."""
    rows, size = [], 0
    own = items.select(F.col(item_id).cast("string").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    for row in own.where("i is not null").toLocalIterator():
        rows.append((row.i, row.t))
        size += 1 + row.t.count(" ") + row.t.count("\n")
        if size >= block_words:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


_compiled: dict[str, list[Searcher]] = {}


def find_benchmark(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, block: int = BLOCK, block_words: int = BLOCK_WORDS,
    text: str = "text", item_id: str = "item_id", item_text: str = "text", keep_text: bool = True,
) -> DataFrame:
    """(doc, n_words, n_hit, hits, items) for every row of `docs`; `doc` has the text if `keep_text`.

    `hits` are the (start, end) word positions inside occurrences, `items` the ids found, sorted.
    """
    spark = docs.sparkSession
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    fields = [("n_words", T.LongType()), ("hits", T.ArrayType(span)), ("items", T.ArrayType(T.StringType()))]
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def one_block(shared):
        key = uuid.uuid4().hex

        def scan(batch: pa.RecordBatch) -> list[pa.Array]:
            if key not in _compiled:
                _compiled.clear()  # one block at a time in a Python worker
                _compiled[key] = searchers(shared.value, window, block)
            first = "__hits" not in batch.schema.names
            counts, hits, found = [], [], []
            for i, value in enumerate(batch.column(text)):
                words = tuple(split_words(value.as_py()))
                spans = [] if first else [(s["start"], s["end"]) for s in batch.column("__hits")[i].as_py()]
                ids = set() if first else set(batch.column("__items")[i].as_py())
                for searcher in _compiled[key]:
                    searcher.search(words, spans, ids)
                counts.append(len(words))
                hits.append([{"start": s, "end": e} for s, e in _merged(spans)])
                found.append(sorted(ids))
            return [pa.array(counts, pa.int64()), pa.array(hits, arrow), pa.array(found, pa.list_(pa.string()))]

        return scan

    out, last = docs, False
    blocks = _item_blocks(items, item_id, item_text, block_words)
    rows = next(blocks, [])
    while not last:
        following = next(blocks, None)
        last = following is None
        hide = ("__hits", "__items", *(() if keep_text or not last else (text,)))
        out = annotate(out, fields, one_block(spark.sparkContext.broadcast(rows)), hide)
        if not last:
            out = out.select("doc.*", F.col("hits").alias("__hits"), F.col("items").alias("__items"))
        rows = following
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc", "n_words", n_hit.alias("n_hit"), "hits", "items")


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def contaminated():
    """The rule over a result of `find_benchmark`."""
    return (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))
