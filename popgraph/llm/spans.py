"""Substring dedup by sliding sentence spans.

A text is cut into sentences (after `.`, `!`, `?` or a line end, before the next word). From every sentence the
shortest run forwards and the shortest run backwards of at least MIN_SENTENCES sentences and MIN_WORDS
words is hashed (128 bits; words in lower case, one space between). All runs of all documents meet by hash;
the first place of a run (smallest document id, then row, then sentence) stays, and every sentence that
any other place of a repeated run covers is removed. A sentence of LONG_WORDS words is a run by itself.

Every shared passage that starts and ends with a sentence is covered whole by its own runs, whatever stands
around it. A document spreads over as many hashes as it has sentences, so one run holds at most one row per
document and place, and the rows of a run are only numbered in order, never gathered.

Defined cases: null text is empty; texts without a word have no sentence and stay as they are; documents with
equal ids go by row; repeated rows are documents of their own; runs repeat inside a document too; an
empty table gives an empty result; other columns stay apart in `doc`.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from popgraph.llm.common import SPACE, annotate, numbered

MIN_SENTENCES = 2
MIN_WORDS = 20
LONG_WORDS = 50

_BREAK = re.compile(rf"(?:(?<=[.!?])[{SPACE}]+|[{SPACE}]*\n[{SPACE}]*)(?=[^{SPACE}])")
_WORD = re.compile(rf"[^{SPACE}]+")


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences; white space behind a sentence is part of it."""
    starts = [0, *(m.end() for m in _BREAK.finditer(text))]
    found = list(zip(starts, [*starts[1:], len(text)]))
    return [s for s in found if _WORD.search(text, *s)]


def runs(sizes: list[int], min_sentences: int, min_words: int, long_words: int) -> set[tuple[int, int]]:
    """(first, behind last) of the shortest runs from every sentence, forwards and backwards."""
    total = [0]
    for n in sizes:
        total.append(total[-1] + n)
    found, end, start, n = set(), 0, 0, len(sizes)

    def enough(a: int, b: int) -> bool:
        size = total[b] - total[a]
        return size >= long_words or (b - a >= min_sentences and size >= min_words)

    for i in range(n):
        end = max(end, i + 1)
        while end < n and not enough(i, end):
            end += 1
        if not enough(i, end):
            break
        found.add((i, end))
    for j in range(n, 0, -1):
        start = j - 1 if j == n else min(start, j - 1)
        while start > 0 and not enough(start, j):
            start -= 1
        if not enough(start, j):
            break
        found.add((start, j))
    return found


def _hashed(text: str, min_sentences: int, min_words: int, long_words: int) -> list[tuple[int, int, int, int]]:
    """(high, low, first, behind last) of every run."""
    parts = [_WORD.findall(text[a:b].lower()) for a, b in sentences(text)]
    digests = [hashlib.blake2b(" ".join(p).encode(), digest_size=16).digest() for p in parts]
    out = []
    for a, b in runs([len(p) for p in parts], min_sentences, min_words, long_words):
        h = digests[a] if b - a == 1 else hashlib.blake2b(b"".join(digests[a:b]), digest_size=16).digest()
        out.append((int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True), a, b))
    return out


def drop_repeated_spans(
    docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, long_words: int = LONG_WORDS,
    text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """(doc, n_sentences, n_removed, removed, kept_text) for every row of `docs`, which must be a table.

    `removed` lists (start, end) character positions of the removed parts.
    """
    own = numbered(docs).select(F.col(doc_id).alias("__id"), "__row", F.col(text).alias("__text"))

    def emit(batches):
        for batch in batches:
            columns = [[], [], [], [], [], []]
            for key, row, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                for found in _hashed(value.as_py() or "", min_sentences, min_words, long_words):
                    for column, x in zip(columns, (key, row, *found)):
                        column.append(x)
            types = [batch.schema.types[0], pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "row", "h1", "h2", "a", "b"])

    places = own.mapInArrow(emit, T.StructType([
        T.StructField("id", docs.schema[doc_id].dataType), *(T.StructField(n, T.LongType()) for n in ("row", "h1", "h2")),
        T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()),
    ]))
    order = Window.partitionBy("h1", "h2").orderBy(F.col("id").isNull(), "id", "row", "a")
    later = places.withColumn("__n", F.row_number().over(order)).where(F.col("__n") > 1)
    gone = later.groupBy("row").agg(F.collect_set(F.struct("a", "b")).alias("__gone"))
    rows = numbered(docs.select(F.struct("*").alias("__doc"), F.col(text).alias("__text")))
    met = rows.join(gone, rows["__row"] == gone["row"], "left").select("__doc", "__text", "__gone")
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def cut(batch: pa.RecordBatch) -> list[pa.Array]:
        counts, removals, spans, texts = [], [], [], []
        for value, runs_gone in zip(batch.column("__text"), batch.column("__gone")):
            whole, found = value.as_py(), runs_gone.as_py() or []
            places = sentences(whole or "")
            covered = {i for r in found for i in range(r["a"], r["b"])}
            merged: list[dict] = []
            for i in sorted(covered):
                start, end = places[i]
                if merged and merged[-1]["end"] == start:
                    merged[-1]["end"] = end
                else:
                    merged.append({"start": start, "end": end})
            rest, at = [], 0
            for m in merged:
                rest.append(whole[at : m["start"]])
                at = m["end"]
            counts.append(len(places))
            removals.append(len(covered))
            spans.append(merged)
            texts.append(whole if not merged else "".join(rest) + whole[at:])
        return [pa.array(counts, pa.int64()), pa.array(removals, pa.int64()), pa.array(spans, span), pa.array(texts, pa.string())]

    pair = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    fields = [("n_sentences", T.LongType()), ("n_removed", T.LongType()), ("removed", pair), ("kept_text", T.StringType())]
    return annotate(met, fields, cut).select(F.col("doc.__doc").alias("doc"), "n_sentences", "n_removed", "removed", "kept_text")
