"""Substring dedup by external induced sorting of sampled suffixes.

A byte goes when a string of LENGTH bytes that covers it starts at two places at least. As in suffix array
construction by induced sorting, only sampled suffixes are sorted, and the order and common prefixes of the
suffixes to their left are induced from theirs:

1. Reduction, recursive (`sample`): S* places are the local minima of the text; the strings between them get
   names (fingerprints, in place of ranks, so that no place needs the others); the S* places of the string of
   names are the sample of the next level. Each keeps the stretch of bytes its choice depends on. A window of
   LENGTH bytes is handed to the S* place of least name among those decided inside it, so equal windows are
   handed to equal places, whatever surrounds them.
2. Sorting: tuples (fingerprint of the bytes right of the sample, fingerprint of all its windows, place) are
   partitioned and sorted by Spark, whose sorter spills sorted runs to disk and merges them by a priority queue.
   Samples alone with their right side are unique and dropped. Where all windows of two samples agree, all are
   repeated. What is left are the borders of repeats: one tuple per different text, now with its bytes.
3. Induction (`induce`): these are sorted by their right side, with the common prefix of neighbours; then
   step by step to the left, the order of the suffixes one byte further left is the old one sorted by that byte,
   and their common prefixes are one more than the least value between. A window is repeated where the common
   prefix with a neighbour reaches LENGTH. Suffixes that can't reach it any more leave the order.

Samples with the same right side and very many different left sides (over HOT) are not gathered in a task: their
windows are counted by 128-bit fingerprints instead.

A document's own repeats are merged before anything is shuffled. Texts are read in pieces, so a text of any
length needs bounded memory up to the last step, which holds one text at a time.

Defined cases: null text is empty; texts shorter than LENGTH lose nothing; matches never cross documents;
repeated rows are documents of their own and remove each other's bytes; an empty table gives an empty result;
other columns stay apart in `doc`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from popgraph.llm.common import annotate, kept, numbered

LENGTH = 200
LEVELS = 2
HOT = 20_000
BATCH = 20_000
PIECE = 1 << 20
MAX_BROADCAST_DOCS = 2_000_000

_u = np.uint64
_rng = np.random.default_rng(20)
_BYTES = _rng.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * _u(2) + _u(1)
_BASES = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _u(30))) * _u(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _u(27))) * _u(0x94D049BB133111EB)
        return x ^ (x >> _u(31))


def _power(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of the bases and of their inverses modulo 2^64, at least n of them."""
    if not _powers or len(_powers[0][0]) < n:
        n = max(n, 1 << 14)
        _powers.clear()
        for base in _BASES:
            pair = []
            for factor in (base, pow(base, -1, 1 << 64)):
                p = np.full(n, factor, dtype=np.uint64)
                p[0] = 1
                pair.append(np.multiply.accumulate(p))
            _powers.append(tuple(pair))
    return _powers


class Fingerprints:
    """Fingerprints of any stretch of a byte string, in two independent versions."""

    def __init__(self, b: np.ndarray):
        self.sums = []
        for (power, _), values in zip(_power(len(b) + 1), _BYTES):
            s = np.empty(len(b) + 1, dtype=np.uint64)
            s[0] = 0
            np.cumsum(values[b] * power[: len(b)], out=s[1:])
            self.sums.append(s)

    def of(self, version: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        s, inverse = self.sums[version], _powers[version][1]
        with np.errstate(over="ignore"):
            return _mixed((s[end] - s[start]) * inverse[start] + _u(version) + (end - start).astype(np.uint64))


def _minima(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index of every run of equal values that is smaller than both neighbouring runs, and the index
    of the next run: the places where a sequence turns from falling to rising."""
    if len(x) < 3:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    v = x[first]
    low = np.flatnonzero((v[1:-1] < v[:-2]) & (v[1:-1] < v[2:])) + 1
    return first[low], first[low + 1]


def sample(b: np.ndarray, prints: Fingerprints, levels: int) -> tuple[np.ndarray, ...]:
    """(place, lo, hi, name) of the S* places after so many reductions. The choice of a place, and its name,
    depend on bytes lo..hi alone."""
    place, after = _minima(b)
    lo, hi = place - 1, after
    for level in range(levels):
        if len(place) < 2:
            return (np.empty(0, dtype=np.int64),) * 3 + (np.empty(0, dtype=np.uint64),)
        name = prints.of(0, place[:-1], place[1:] + 1)
        own_lo, own_hi = lo[:-1], hi[1:]
        if level == levels - 1:
            return place[:-1], own_lo, own_hi, name
        at, after = _minima(name)
        place, lo, hi = place[:-1][at], own_lo[at - 1], own_hi[after]
    raise ValueError("levels must be positive")


def _least(name: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Index of the first least name in start..end-1, for many non-empty ranges."""
    table = [np.arange(len(name))]
    for k in range(int(np.max(end - start)).bit_length() - 1):
        a, b = table[-1][: -(1 << k)], table[-1][1 << k :]
        table.append(np.where(name[b] < name[a], b, a))
    out = np.empty(len(start), dtype=np.int64)
    level = np.frexp((end - start).astype(np.float64))[1] - 1
    for k in range(len(table)):
        own = level == k
        a, b = table[k][start[own]], table[k][end[own] - (1 << k)]
        out[own] = np.where(name[b] < name[a], b, a)
    return out


def assigned(b: np.ndarray, n: int, prints: Fingerprints, length: int, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window): which place the windows 0..n-1 are handed to. A window in which no
    place is decided, as in periodic text, is its own anchor."""
    place, lo, hi, name = sample(b, prints, levels)
    cuts = np.concatenate([[0], lo + 1, hi - length + 1])
    cuts = np.unique(cuts[(cuts >= 0) & (cuts < n)])
    last = np.append(cuts[1:], n) - 1
    start, end = np.searchsorted(lo, cuts), np.searchsorted(hi, cuts + length - 1, side="right")
    some = end > start
    chosen = _least(name, start[some], end[some]) if some.any() else np.empty(0, dtype=np.int64)
    first, last_of = cuts[some], last[some]
    new = np.concatenate([[True], (chosen[1:] != chosen[:-1])]) if len(chosen) else np.empty(0, dtype=bool)
    at = np.flatnonzero(new)
    ends = np.append(at[1:], len(chosen)) - 1
    alone = _ranges(cuts[~some], last[~some])
    if len(at) == 0:
        return alone, alone, alone
    return (
        np.concatenate([place[chosen[at]], alone]), np.concatenate([first[at], alone]), np.concatenate([last_of[ends], alone]),
    )


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers of many ranges first..last."""
    n = last - first + 1
    if not len(n):
        return np.empty(0, dtype=np.int64)
    return np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def tuples(b: np.ndarray, n: int, length: int, levels: int) -> tuple[np.ndarray, ...]:
    """(right, whole, t, least, most): for every sample t, its windows start `least`..`most` bytes before it.

    `right` is the fingerprint of the bytes from t on that all windows of any such sample share; `whole` that
    of all bytes of these windows.
    """
    prints = Fingerprints(b)
    chunk = length // 2
    anchor, first, last = assigned(b, n, prints, length, levels)
    parts = []
    for k in range(-(-length // chunk)):  # windows far left of their place get a place `chunk` bytes further left
        t = anchor - k * chunk
        least, most = np.maximum(t - last, 0), np.minimum(t - first, chunk - 1)
        good = least <= most
        parts.append((t[good], least[good], most[good]))
    t, least, most = (np.concatenate(p) for p in zip(*parts))
    right = prints.of(0, t, t + length - chunk + 1)
    whole = prints.of(1, t - most, t - least + length) ^ _mixed((least * 1024 + most).astype(np.uint64))
    return right, whole, t, least, most


def _packed(t, least, most):
    return (t << 16) | (least << 8) | most


def _intervals(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals start..end-1, touching ones merged."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    at = np.flatnonzero(new)
    return start[at], end[np.append(at[1:], len(start)) - 1]


def _sampled(rows: DataFrame, length: int, levels: int) -> DataFrame:
    """(right, whole, row, weight, a, b): weight 1 or 2 (met again in its document) for a sample with a = its packed
    place; weight 0 for windows a..b that repeat inside their document."""

    def run(batches):
        for batch in batches:
            parts = []
            for row, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = (value.as_py() or "").encode()
                for at in range(0, len(raw) - length + 1, PIECE):
                    b = np.frombuffer(raw, dtype=np.uint8, count=min(PIECE + length - 1, len(raw) - at), offset=at)
                    right, whole, t, least, most = tuples(b, len(b) - length + 1, length, levels)
                    order = np.lexsort((t, whole, right))
                    right, whole, t, least, most = right[order], whole[order], t[order] + at, least[order], most[order]
                    new = np.concatenate([[True], (right[1:] != right[:-1]) | (whole[1:] != whole[:-1])])
                    first = np.flatnonzero(new)
                    counts = np.diff(np.append(first, len(t)))
                    twice = np.repeat(counts > 1, counts)
                    a, b_ = _intervals((t - most)[twice], (t - least)[twice] + 1)
                    parts.append((right[first], whole[first], np.full(len(first), row), np.minimum(counts, 2), _packed(t, least, most)[first], np.zeros(len(first), np.int64)))
                    if len(a):
                        alone = _mixed(a.astype(np.uint64) + _mixed(np.full(len(a), row, dtype=np.int64).view(np.uint64)))
                        parts.append((alone, alone, np.full(len(a), row), np.zeros(len(a), np.int64), a, b_ - 1))
            if parts:
                columns = [np.concatenate(c) for c in zip(*parts)]
                columns[0], columns[1] = columns[0].view(np.int64), columns[1].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64, copy=False)) for c in columns], names=["right", "whole", "row", "weight", "a", "b"])

    return rows.mapInArrow(run, "right bigint, whole bigint, row bigint, weight bigint, a bigint, b bigint")


def induce(group: np.ndarray, bytes_: np.ndarray, have: np.ndarray, least: np.ndarray, most: np.ndarray, length: int) -> np.ndarray:
    """Which windows are repeated: a boolean matrix, sample by offset.

    Samples are sorted by group and by their bytes from `chunk` on, of which `have` are given; `bytes_` holds
    chunk - 1 bytes to the left as well.
    """
    left = length // 2 - 1
    m = len(group)
    out = np.zeros((m, left + 1), dtype=bool)
    order = np.arange(m)
    right = bytes_[:, left:]
    same = np.concatenate([[False], group[1:] == group[:-1]])
    lcp = np.zeros(m + 1, dtype=np.int64)
    for at in range(1, m, 4096):
        end = min(at + 4096, m)
        differs = right[at:end] != right[at - 1 : end - 1]
        first = np.where(differs.any(axis=1), differs.argmax(axis=1), right.shape[1])
        lcp[at:end] = np.minimum(first, np.minimum(have[at:end], have[at - 1 : end - 1])) * same[at:end]
    for step in range(left + 1):
        now = np.flatnonzero(least[order] <= step)  # these have a window here; a place can stand twice, with other windows
        if len(now):
            gap = np.minimum.reduceat(lcp, now + 1)
            gap[-1] = 0
            out[order[now], step] = np.maximum(gap, np.concatenate([[0], gap[:-1]])) >= length
        near = np.maximum(lcp[:-1], lcp[1:])
        go = (most[order] > step) & (near + most[order] - step >= length)
        at = np.flatnonzero(go)
        if step == left or not len(at):
            break
        byte = bytes_[order[at], left - step - 1]
        key = group[order[at]] * 256 + byte
        at = at[np.argsort(key, kind="stable")]
        key = group[order[at]] * 256 + bytes_[order[at], left - step - 1]
        between = np.minimum.reduceat(lcp, at + 1) if len(at) else lcp[:0]
        joined = np.concatenate([[False], key[1:] == key[:-1]])
        fresh = np.zeros(len(at) + 1, dtype=np.int64)
        fresh[1 : len(at)] = np.where(joined[1:], between[:-1] + 1, 0)
        order, lcp = order[at], fresh
    return out


def _windows(out: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sample, first window, last window) of the runs in a result of `induce`."""
    flat = np.zeros((out.shape[0], out.shape[1] + 2), dtype=np.int8)
    flat[:, 1:-1] = out
    turn = np.diff(flat, axis=1)
    i, start = np.nonzero(turn == 1)
    _, end = np.nonzero(turn == -1)
    return i, t[i] - end + 1, t[i] - start


def _borders(docs: DataFrame, borders: DataFrame, text: str, length: int) -> DataFrame:
    """(core, row, a, single, hot, have, bytes): border samples with their bytes, left and right."""
    left = length // 2 - 1
    who = borders.select("row").distinct()
    texts = numbered(docs).select("__row", F.col(text).alias("text"))
    if who.count() <= MAX_BROADCAST_DOCS:
        texts = texts.join(F.broadcast(who), F.col("__row") == F.col("row"), "left_semi")
    lists = borders.groupBy("row").agg(F.collect_list(F.struct("core", "a", "single", "hot")).alias("places"))
    met = texts.join(lists, F.col("__row") == F.col("row")).select("row", "text", "places")

    def run(batches):
        for batch in batches:
            columns = [[], [], [], [], [], [], []]
            for row, value, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                raw = value.as_py().encode()
                for p in places.as_py():
                    t = p["a"] >> 16
                    end = min(len(raw), t + length)
                    part = b"\0" * max(0, left - t) + raw[max(0, t - left) : end]
                    for column, x in zip(columns, (p["core"], row, p["a"], p["single"], p["hot"], end - t, part)):
                        column.append(x)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["core", "row", "a", "single", "hot", "have", "bytes"])

    return met.mapInArrow(run, "core bigint, row bigint, a bigint, single boolean, hot boolean, have bigint, bytes binary")


def _induced(borders: DataFrame, length: int) -> DataFrame:
    """(row, a, b): windows a..b of border samples that are repeated."""
    left, width = length // 2 - 1, length // 2 - 1 + length
    right = F.expr(f"substring(bytes, {left + 1})")
    dealt = borders.repartition("core").sortWithinPartitions(F.col("core"), right, F.col("row"), F.col("a"))

    def solve(rows):
        core, row, a, single, have, parts = (list(c) for c in zip(*rows))
        packed = np.array(a, dtype=np.int64)
        grid = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), dtype=np.uint8).reshape(len(parts), width)
        _, group = np.unique(np.array(core, dtype=np.int64), return_inverse=True)
        found = induce(group, grid, np.array(have), (packed >> 8) & 255, packed & 255, length)
        found &= np.array(single)[:, None]
        i, first, last = _windows(found, packed >> 16)
        return pa.RecordBatch.from_arrays([pa.array(np.array(row, dtype=np.int64)[i]), pa.array(first), pa.array(last)], names=["row", "a", "b"])

    def run(batches):
        rows, last = [], None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("core", "row", "a", "single", "have", "bytes")]
            for item in zip(*columns):
                if item[0] != last and len(rows) >= BATCH:
                    yield solve(rows)
                    rows = []
                last = item[0]
                rows.append(item)
        if rows:
            yield solve(rows)

    return dealt.mapInArrow(run, "row bigint, a bigint, b bigint")


def _counted(borders: DataFrame, length: int) -> DataFrame:
    """The same as `_induced` for samples of hot groups: every window counts by its fingerprints."""
    left = length // 2 - 1

    def run(batches):
        for batch in batches:
            parts = []
            for row, packed, single, raw in zip(*(batch.column(c).to_pylist() for c in ("row", "a", "single", "bytes"))):
                least, most = (packed >> 8) & 255, packed & 255
                prints = Fingerprints(np.frombuffer(raw, dtype=np.uint8))
                start = left - np.arange(least, most + 1)
                h = [prints.of(v, start, start + length).view(np.int64) for v in (0, 1)]
                parts.append((*h, np.full(len(start), row), (packed >> 16) - left + start, np.full(len(start), single)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=["h0", "h1", "row", "a", "single"])

    each = borders.mapInArrow(run, "h0 bigint, h1 bigint, row bigint, a bigint, single boolean")
    many = each.groupBy("h0", "h1").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("h0", "h1")
    return each.where("single").join(many, ["h0", "h1"], "left_semi").select("row", "a", F.col("a").alias("b"))


def repeated_windows(docs: DataFrame, length: int, levels: int, text: str, hot: int) -> DataFrame:
    """(row, a, b): windows a..b of each document start at another place as well."""
    rows = numbered(docs).select("__row", text)
    core, whole = Window.partitionBy("right"), Window.partitionBy("right", "whole")
    first = Window.partitionBy("right", "whole").orderBy("row", "a")
    met = _sampled(rows, length, levels).select(
        "*", F.sum("weight").over(whole).alias("same"), F.row_number().over(first).alias("nth")
    )
    met = met.select("*", F.sum("weight").over(core).alias("all"), F.min("same").over(core).alias("fewest"), F.sum(F.when(F.col("nth") == 1, 1)).over(core).alias("different"))
    met = kept(met.where((F.col("weight") == 0) | (F.col("all") > 1)).select(
        F.col("right").alias("core"), "row", "weight", "a", "b", "same", (F.col("different") > hot).alias("hot"),
        ((F.col("fewest") == 1) & (F.col("nth") == 1) & (F.col("different") > 1)).alias("border"),
    ), "samples")
    t, least, most = F.shiftright("a", 16), F.shiftright("a", 8).bitwiseAND(255), F.col("a").bitwiseAND(255)
    inside = met.where("weight = 0").select("row", "a", "b")
    equal = met.where("weight > 0 and same > 1").select("row", (t - most).alias("a"), (t - least).alias("b"))
    borders = met.where("weight > 0 and border").select("core", "row", "a", (F.col("same") == 1).alias("single"), "hot")
    borders = kept(_borders(docs, borders, text, length), "borders")
    return inside.unionByName(equal).unionByName(_induced(borders.where("not hot"), length)).unionByName(_counted(borders.where("hot"), length))


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, levels: int = LEVELS, text: str = "text", hot: int = HOT, carry: list[str] | None = None
) -> DataFrame:
    """(doc, n_bytes, removed, kept) for every row of `docs`, which must be a table.

    `removed` are the (start, end) byte positions of maximal removed runs, `kept` the remaining bytes, which need not
    be valid UTF-8; `doc` has the columns `carry` (default: all). `length` is even and at most 512.
    """
    windows = kept(repeated_windows(docs, length, levels, text, hot), "windows")
    lists = windows.groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("__windows"))
    own = numbered(docs).select("__row", F.struct(*(carry or docs.columns)).alias("__doc"), F.col(text).alias("__text"))
    met = own.join(lists, F.col("__row") == F.col("row"), "left").select("__doc", "__text", "__windows")
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    arrow = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def cut(batch: pa.RecordBatch) -> list[pa.Array]:
        sizes, offsets, starts, ends, rest = [], [0], [], [], []
        for value, found in zip(batch.column("__text"), batch.column("__windows")):
            raw = (value.as_py() or "").encode()
            start, end = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
            if found.is_valid:
                inner = found.values
                start, end = _intervals(inner.field("a").to_numpy(), inner.field("b").to_numpy() + length)
            at, parts = 0, []
            for s, e in zip(start.tolist(), end.tolist()):
                parts.append(raw[at:s])
                at = e
            sizes.append(len(raw))
            offsets.append(offsets[-1] + len(start))
            starts.append(start)
            ends.append(end)
            rest.append(b"".join(parts) + raw[at:])
        both = [np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (starts, ends)]
        spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in both], fields=list(arrow)))
        return [pa.array(sizes, pa.int64()), spans, pa.array(rest, pa.binary())]

    fields = [("n_bytes", T.LongType()), ("removed", T.ArrayType(span)), ("kept", T.BinaryType())]
    out = annotate(met, fields, cut, hide=("__text", "__windows"))
    return out.select(F.col("doc.__doc").alias("doc"), "n_bytes", "removed", "kept")
