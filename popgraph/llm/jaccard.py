"""N-gram Jaccard join: a forest of count-vector R-trees over hashed shingles.

A document's set are its distinct shingles of N words, as 64-bit hashes. Equal sets are one class, found by a
128-bit hash, so copies are joined by counting. Two different sets A, B link when
100 |A and B| >= t |A or B|, so they differ in at most d = (100-t)/(100+t) (|A|+|B|) shingles.

1. Which sets meet: sets are cut into size slabs such that links stay inside a slab or cross to the next one. In a
   slab, shingles are hashed into G > d groups: d differences spoil at most d groups, so linked sets agree
   wholly in G - d of them at least. (slab, group, hash of the group's shingles) is a key, and sets with the same
   key meet in its bucket. G has some groups to spare: a set with few empty groups has no key for these, and one
   with few crowded keys (of more than HOT sets) leaves these out, few being half of the spare each; it still
   shares a key with every partner. Sets that don't keep to it use such keys among themselves.
2. In a bucket, the counts of shingles per group, with about eight shingles to a group, are points of a packed R-tree.
   The sum of coordinate minima bounds the overlap of two sets, and of a set with all sets in a node. Sets that may
   reach the overlap they need are in one cluster. Buckets with the same sets are looked at once; crowded
   buckets are clusters as they are.
3. In a cluster, the same bound chooses the sets that are verified on their shingles. Sets already connected are not
   verified again, as only components are asked for, and no pair of sets is listed but one a step of a component.
4. A cluster over CELL_SETS sets or CELL_SHINGLES shingles is cut into chunks, twice by different hashes; links inside these
   join most sets that copies make. Sets outside the largest component of that are then looked at with every chunk of it
   and with each other, in cells of at most WIDE_SETS sets and WIDE_SHINGLES shingles. No task holds more than a cell, and a large group of copies meets each chunk once.

Defined cases: null and empty texts, and texts without words, have no shingle and link with nothing (their own
component); fewer than N words make one shingle; equal ids are documents of their own, and a component's id is the
smallest id in it; a null id is never the smallest unless all are null; an empty table gives an empty result; other
columns stay apart in `doc`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from popgraph.llm.common import kept, numbered
from popgraph.llm.graphs import components

WORDS, PERCENT = 3, 90
PER_GROUP, LEAST_GROUPS, MOST_GROUPS = 8, 32, 4096
HOT = 64
SPARE = 0.25  # groups beyond d + 1, as a share
CELL_SETS, CELL_SHINGLES = 1000, 1_000_000
WIDE_SETS, WIDE_SHINGLES = 16_000, 4_000_000  # cells of what is left after these
MAX_BROADCAST_MEMBERS = 1_000_000  # rows of four numbers
LEAF, FANOUT, BLOCK = 16, 16, 64
CHUNK = 2_000_000  # numbers looked at together
CACHED_WORDS = 500_000

_u = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _u(30))) * _u(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _u(27))) * _u(0x94D049BB133111EB)
        return x ^ (x >> _u(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def shingles(text: str | None, n: int, hashes: _WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes; A-Z in lower case, words between ASCII white space."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter((hashes[w] for w in words), dtype=np.uint64, count=len(words))
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, width, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = mixed(out * _u(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i])
    return np.unique(out)


class Slabs:
    """Size slabs for a threshold of `percent`: their greatest sizes, allowed differences and groups."""

    def __init__(self, percent: int):
        self.t, self.tops = percent, [1]

    def reach(self, size: int) -> int:
        """The largest size a set of this size can link with."""
        return size * 100 // self.t

    def of(self, size: int) -> list[int]:
        while self.tops[-1] < self.reach(size):
            self.tops.append(max(self.tops[-1] + 1, self.reach(self.tops[-1])))
        own = int(np.searchsorted(self.tops, size))
        return [own, own + 1] if self.reach(size) > self.tops[own] else [own]

    def differences(self, slab: int) -> int:
        return 2 * self.tops[slab] * (100 - self.t) // (100 + self.t)

    def spare(self, slab: int) -> int:
        """How many empty groups, and how many crowded keys, a set may leave out."""
        return int(SPARE * (self.differences(slab) + 1)) // 2

    def groups(self, slab: int) -> int:
        return self.differences(slab) + 1 + 2 * self.spare(slab)


def keys(found: np.ndarray, slabs: Slabs) -> list[tuple[int, np.ndarray]]:
    """(slab, a key per group) for every slab the set belongs to; none for empty groups if they are few."""
    out, spread = [], mixed(found ^ _u(0x5851F42D4C957F2D))
    for slab in slabs.of(len(found)):
        n = slabs.groups(slab)
        group = (found % _u(n)).astype(np.int64)
        sums = np.zeros(n, dtype=np.uint64)
        np.add.at(sums, group, spread)
        with np.errstate(over="ignore"):
            place = mixed(np.arange(n, dtype=np.uint64) * _u(0x9E3779B97F4A7C15) + _u(slab + 1))
            key = mixed(sums + place)
        full = np.bincount(group, minlength=n) > 0
        out.append((slab, key[full] if n - full.sum() <= slabs.spare(slab) else key))
    return out


def counts(found: np.ndarray) -> np.ndarray:
    """Shingles per group; the number of groups is a power of two that suits the set's size."""
    n = LEAST_GROUPS
    while n < MOST_GROUPS and n * PER_GROUP < len(found):
        n *= 2
    return np.bincount((mixed(found) >> _u(40)).astype(np.int64) % n, minlength=n).astype(np.int32)


def folded(vectors: list[np.ndarray]) -> np.ndarray:
    """Count vectors as rows, brought to the smallest number of groups among them."""
    n = min(map(len, vectors))
    return np.stack([v.reshape(-1, n).sum(axis=0, dtype=np.int32) for v in vectors])


def sizes_and_classes(docs: DataFrame, n: int, text: str, doc_id: str) -> DataFrame:
    """(row, id, size, k1, k2, counts) of `docs` with a `__row`: set sizes, 128-bit hashes and count vectors."""

    def run(batches):
        hashes = _WordHashes()
        for batch in batches:
            size, k1, k2, vectors = [], [], [], []
            for value in batch.column(2):
                found = shingles(value.as_py(), n, hashes)
                digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                size.append(len(found))
                vectors.append(counts(found).astype(np.uint16 if len(found) < 1 << 16 else np.int32).tobytes())
                k1.append(int.from_bytes(digest[:8], "little", signed=True))
                k2.append(int.from_bytes(digest[8:], "little", signed=True))
            columns = [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in (size, k1, k2))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(vectors, pa.binary())], names=["row", "id", "size", "k1", "k2", "counts"])

    own = docs.select("__row", F.col(doc_id).alias("id"), F.col(text).alias("text"))
    long = T.LongType()
    schema = T.StructType([T.StructField("row", long), T.StructField("id", own.schema["id"].dataType), *(T.StructField(c, long) for c in ("size", "k1", "k2")), T.StructField("counts", T.BinaryType())])
    return own.mapInArrow(run, schema)


def set_keys(docs: DataFrame, n: int, percent: int, text: str) -> DataFrame:
    """(key, k1, slab, spare): the keys of every different set, once per task."""

    def run(batches):
        hashes, slabs, seen = _WordHashes(), Slabs(percent), set()
        for batch in batches:
            parts = []
            for value in batch.column(0):
                found = shingles(value.as_py(), n, hashes)
                if not len(found):
                    continue
                k1 = int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=16).digest()[:8], "little", signed=True)
                if k1 in seen:
                    continue
                seen.add(k1)
                for slab, key in keys(found, slabs):
                    m = len(key)
                    parts.append((key.view(np.int64), np.full(m, k1), np.full(m, slab, np.int32), np.full(m, slabs.spare(slab), np.int32)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=["key", "k1", "slab", "spare"])

    return docs.select(text).mapInArrow(run, "key bigint, k1 bigint, slab int, spare int")


def clusters(docs: DataFrame, classes: DataFrame, n: int, percent: int, text: str, hot: int) -> DataFrame:
    """(k1, cluster): sets that may be connected by links are in one cluster; sets alone are left out."""
    by_key = Window.partitionBy("key")
    met = set_keys(docs, n, percent, text).select(
        "*", F.count(F.lit(1)).over(by_key).alias("n"), F.min("k1").over(by_key).alias("low"), F.max("k1").over(by_key).alias("high")
    )
    met = kept(met.where(F.col("low") != F.col("high")), "keys")
    buckets = met.where(F.col("n") <= hot).groupBy("key").agg(F.array_sort(F.collect_set("k1")).alias("sets"))
    buckets = buckets.select("sets").distinct().select(F.xxhash64("sets").alias("bucket"), F.explode("sets").alias("k1"))
    crowded = met.where(F.col("n") > hot)
    few = crowded.groupBy("k1", "slab").agg(F.count_distinct("key").alias("lost"), F.max("spare").alias("spare"))
    few = few.where(F.col("lost") > F.col("spare")).select("k1", "slab")
    among = crowded.join(few, ["k1", "slab"], "left_semi").select("key", "k1").distinct()
    rest = among.select(F.col("k1").alias("a"), F.min("k1").over(by_key).alias("b"))
    edges = bucket_edges(buckets, classes, percent).unionByName(rest)
    return components(contracted(edges)).select(F.col("node").alias("k1"), F.col("comp").alias("cluster"))


def contracted(edges: DataFrame) -> DataFrame:
    """Edges that connect the same sets: a set keeps its smallest partner, and its other partners go there instead of to it.

    The sets of a group of copies have the same few partners, so about one edge a set is left. A set has no more partners than keys.
    """
    partners = edges.where(F.col("a") != F.col("b")).groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("bs"))
    least = F.get("bs", F.lit(0))
    own = partners.select("a", least.alias("b"))
    return own.unionByName(partners.select(F.explode(F.expr("slice(bs, 2, size(bs))")).alias("a"), least.alias("b"))).distinct()


def bucket_edges(buckets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): edges that connect the sets of a bucket whose count vectors allow a link."""
    met = buckets.join(classes.select("k1", "size", "counts"), "k1").select("bucket", "k1", "size", "counts")
    dealt = met.repartition("bucket").sortWithinPartitions("bucket", "k1")

    def solve(bucket):
        k1, size, vectors = zip(*bucket)
        found = [np.frombuffer(v, dtype=np.uint16 if n < 1 << 16 else np.int32).astype(np.int32) for v, n in zip(vectors, size)]
        return stars(k1, connected(folded(found), np.array(size, dtype=np.int64), percent, None))

    return _by_group(dealt, ["bucket"], ["k1", "size", "counts"], solve)


def stars(names: tuple, links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(name, smallest name of its component) for linked places of `names`, which rise.

    Near copies share many buckets; hung on the smallest, they give the same edge in most of them.
    """
    label = list(range(len(names)))

    def find(x: int) -> int:
        while label[x] != x:
            label[x] = x = label[label[x]]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        label[high] = low
    return [(names[i], names[find(i)]) for i in range(len(names)) if find(i) != i]


def _by_group(dealt: DataFrame, keys: list[str], columns: list[str], solve) -> DataFrame:
    """(a, b) from `solve(rows)` for every group of sorted rows with at least two."""

    def run(batches):
        last, group = None, []
        for batch in batches:
            out = []
            names = zip(*(batch.column(c).to_pylist() for c in keys))
            for key, row in zip(names, zip(*(batch.column(c).to_pylist() for c in columns))):
                if key != last:
                    out += solve(group) if len(group) > 1 else []
                    last, group = key, []
                group.append(row)
            yield _edges(out)
        yield _edges(solve(group) if len(group) > 1 else [])

    def _edges(found):
        a, b = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint")


class RTree:
    """Packed R-tree over count vectors: leaves of LEAF points, nodes of FANOUT children; a node keeps its
    upper corner and its smallest and largest set size."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        self.order = self._packed(vectors, sizes)
        v, s = vectors[self.order], sizes[self.order]
        self.levels = []  # from the leaves up: upper corners, least and greatest sizes
        step = LEAF
        while True:
            at = np.arange(0, len(v), step)
            self.levels.append((step, np.maximum.reduceat(v, at), np.minimum.reduceat(s, at), np.maximum.reduceat(s, at)))
            if len(at) == 1:
                break
            step *= FANOUT

    @staticmethod
    def _packed(vectors: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Order of the points: halves along the widest coordinate, or size, until a leaf is left."""
        points = np.column_stack([sizes, vectors])
        out, todo = [], [np.arange(len(points))]
        while todo:
            own = todo.pop()
            if len(own) <= LEAF:
                out.append(own)
                continue
            part = points[own]
            axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            half = -(-len(own) // 2 // LEAF) * LEAF
            own = own[np.argsort(part[:, axis], kind="stable")]
            todo += [own[half:], own[:half]]
        return np.concatenate(out)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    both = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))
    return 100 * both >= percent * (len(a) + len(b) - both)


def connected(
    vectors: np.ndarray, sizes: np.ndarray, percent: int, linked_sets, known: np.ndarray | None = None
) -> list[tuple[int, int]]:
    """Edges that connect what pairs connect, at most one less than sets: positions in `vectors`.

    Pairs are those whose bound allows a link and, if given, for which `linked_sets(i, j)` is true. Places with the same
    number in `known` are connected already.
    """
    tree = RTree(vectors, sizes)
    order = tree.order
    v, sizes = vectors[order], sizes[order]
    label, found = np.arange(len(sizes)) if known is None else known[order].copy(), []

    def overlap(q: np.ndarray, corner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Sum of coordinate minima of points q and corners `at`, piece by piece."""
        step = max(1, CHUNK // v.shape[1])
        parts = [np.minimum(v[q[i : i + step]], corner[at[i : i + step]]).sum(axis=1) for i in range(0, len(q), step)]
        return np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)

    def possible(q: np.ndarray, corner: np.ndarray, least: np.ndarray, most: np.ndarray, at: np.ndarray) -> np.ndarray:
        """May a set of q's size reach the overlap it needs with some set under the corner?"""
        own, least, most = sizes[q], least[at], most[at]
        small = np.maximum(least, -(-percent * own // 100))
        fits = (100 * most >= percent * own) & (percent * least <= 100 * own)
        return fits & ((100 + percent) * overlap(q, corner, at) >= percent * (own + small))

    for start in range(0, len(sizes), BLOCK):
        block = np.arange(start, min(start + BLOCK, len(sizes)))
        step, corner, least, most = tree.levels[-1]
        q, node = block, np.zeros(len(block), dtype=np.int64)
        for depth in range(len(tree.levels) - 1, -1, -1):
            step, corner, least, most = tree.levels[depth]
            early = node * step < q  # a pair is looked at from its later point
            q, node = q[early], node[early]
            good = possible(q, corner, least, most, node)
            q, node = q[good], node[good]
            wide = FANOUT if depth else LEAF
            last = len(tree.levels[depth - 1][1]) if depth else len(sizes)
            q = np.repeat(q, wide)
            node = (node[:, None] * wide + np.arange(wide)).ravel()
            inside = node < last
            q, node = q[inside], node[inside]
        good = (node < q) & (label[q] != label[np.minimum(node, len(sizes) - 1)])
        q, node = q[good], node[good]
        good = possible(q, v, sizes, sizes, node)
        q, node = q[good], node[good]
        bound = overlap(q, v, node)
        for i in np.lexsort((-bound, q)):
            a, b = q[i], node[i]
            if label[a] != label[b] and (linked_sets is None or linked_sets(order[a], order[b])):
                found.append((int(order[a]), int(order[b])))
                low, high = sorted((label[a], label[b]))
                label[label == high] = low
    return found


def cell_links(sets: list[np.ndarray], percent: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what links connect, at most one less than sets: positions in `sets`."""
    vectors, sizes = folded([counts(s) for s in sets]), np.array([len(s) for s in sets], dtype=np.int64)
    return connected(vectors, sizes, percent, lambda i, j: linked(sets[i], sets[j], percent), known)


def cluster_sets(members: DataFrame, docs: DataFrame, n: int, text: str) -> DataFrame:
    """(row, size, cluster, parts, found): shingles of the clusters' sets and the number of chunks of each cluster."""
    total = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("sets"), F.sum("size").alias("shingles"))
    parts = F.ceil(F.greatest(F.col("sets") / (CELL_SETS / 2), F.col("shingles") / (CELL_SHINGLES / 2)))
    fits = (F.col("sets") <= CELL_SETS) & (F.col("shingles") <= CELL_SHINGLES)
    total = total.where(F.col("sets") > 1).select("cluster", F.when(fits, 1).otherwise(parts).cast("int").alias("parts"))
    placed = kept(members.join(total, "cluster").select("row", "size", "cluster", "parts"), "placed")
    small = F.broadcast(placed) if placed.count() <= MAX_BROADCAST_MEMBERS else placed  # else texts are shuffled by row
    met = numbered(docs).select("__row", F.col(text).alias("text")).join(small, F.col("__row") == F.col("row"))

    def read(batches):
        hashes = _WordHashes()
        for batch in batches:
            found = [shingles(v.as_py(), n, hashes).tobytes() for v in batch.column("text")]
            names = ["row", "size", "cluster", "parts"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.binary())], names=[*names, "found"])

    own = met.select("row", "size", "cluster", "parts", "text").mapInArrow(read, "row bigint, size bigint, cluster bigint, parts int, found binary")
    return kept(own, "shingles")


def cluster_links(members: DataFrame, docs: DataFrame, n: int, percent: int, text: str) -> DataFrame:
    """(a, b) rows of sets that link, enough to connect each component. `members` = (row, size, cluster)."""
    sets = cluster_sets(members, docs, n, text)

    def solve(cell):
        rows, found, known = zip(*cell)
        labels = {}
        known = np.array([labels.setdefault(("row", r) if k is None else k, i) for i, (r, k) in enumerate(zip(rows, known))])
        return stars(rows, cell_links([np.frombuffer(f, dtype=np.uint64) for f in found], percent, known))

    def cells(dealt: DataFrame, keys: list[str]) -> DataFrame:
        return _by_group(dealt.repartition(*keys).sortWithinPartitions(*keys, "row"), keys, ["row", "found", "known"], solve)

    # 1. chunks of the first dealing, for clusters of several chunks also of a second one
    dealing = F.explode(F.when(F.col("parts") > 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    inside = sets.withColumn("dealing", dealing).withColumn("chunk", F.pmod(F.xxhash64("row", "dealing"), "parts").cast("int"))
    near = kept(cells(inside.withColumn("known", F.lit(None).cast("bigint")), ["cluster", "dealing", "chunk"]), "near")
    large = sets.where("parts > 1")
    if large.isEmpty():
        return near

    # 2. sets outside the largest component against its chunks and against each other
    comps = components(near).withColumnRenamed("node", "row")
    named = kept(large.select("row", "size", "cluster", "parts").join(comps, "row", "left").withColumn("known", F.coalesce("comp", "row")).drop("comp"), "named")
    heads = named.groupBy("cluster", "known").agg(F.count(F.lit(1)).alias("sets")).groupBy("cluster").agg(F.max_by("known", F.struct("sets", "known")).alias("head"))
    named = named.drop("parts").join(F.broadcast(heads), "cluster").withColumn("in_head", F.col("known") == F.col("head"))  # few clusters are so large

    def chunks(own: Column) -> Column:
        sets_of, shingles_of = F.count_if(own) / (WIDE_SETS / 2), F.sum(F.when(own, F.col("size")).otherwise(0)) / (WIDE_SHINGLES / 2)
        return F.ceil(F.greatest(sets_of, shingles_of)).cast("int")

    left = named.groupBy("cluster").agg(chunks(F.col("in_head")).alias("parts"), chunks(~F.col("in_head")).alias("others"))
    named = named.join(F.broadcast(left.where("others > 0")), "cluster")  # clusters that are one component are done
    met = sets.select("row", "found").join(named.select("row", "cluster", "parts", "others", "known", "in_head"), "row")
    chunk = F.pmod(F.xxhash64("row", F.lit(3)), F.when(F.col("in_head"), F.col("parts")).otherwise(F.col("others"))).cast("int")
    met = met.withColumn("chunk", chunk)

    def cell(kind: int, x, y):
        return F.struct(F.lit(kind).alias("kind"), x.cast("int").alias("x"), y.cast("int").alias("y"))

    # a chunk of the largest component with a chunk of the others (0), and two chunks of the others (1)
    heads_of = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: cell(0, x, F.col("chunk")))
    with_others = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda y: cell(1, F.least(y, "chunk"), F.greatest(y, "chunk")))
    of_head = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda y: cell(0, F.col("chunk"), y))
    across = met.select("cluster", "row", "found", "known", F.explode(F.when(F.col("in_head"), of_head).otherwise(F.concat(heads_of, with_others))).alias("cell"))
    across = across.select("cluster", "cell.kind", "cell.x", "cell.y", "row", "found", "known")
    return near.unionByName(cells(across, ["cluster", "kind", "x", "y"]))


def join_sets(
    docs: DataFrame, n: int = WORDS, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id", hot: int = HOT
) -> DataFrame:
    """(row, id, n_shingles, component_id, is_first) per document, `row` as given by `numbered(docs)`.

    `is_first` marks one document of every component: the first row with the smallest id. `docs` must be a table.
    """
    own = kept(sizes_and_classes(numbered(docs), n, text, doc_id), "sets")
    known = own.where("size > 0")
    first = F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("id"), F.col("row").alias("row"))
    classes = known.groupBy("k1", "k2", "size").agg(F.min("row").alias("rep"), F.min(first).alias("first"), F.first("counts").alias("counts"))
    classes = kept(classes, "classes")
    grouped = clusters(docs, classes, n, percent, text, hot)
    members = kept(classes.join(grouped, "k1").select(F.col("rep").alias("row"), "size", "cluster"), "members")
    links = components(cluster_links(members, docs, n, percent, text))
    met = classes.join(links, classes["rep"] == links["node"], "left").withColumn("comp", F.coalesce("comp", "rep"))
    firsts = met.where(F.col("node").isNotNull()).groupBy("comp").agg(F.min("first").alias("of_comp"))
    named = met.select("k1", "k2", "first", "comp").join(firsts, "comp", "left").select(
        "k1", "k2", F.coalesce("of_comp", "first").alias("first")
    )
    out = own.join(named.withColumnsRenamed({"k1": "c1", "k2": "c2"}), (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & (F.col("size") > 0), "left")
    return out.select(
        "row", "id", F.col("size").alias("n_shingles"), F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("component_id"),
        F.coalesce(F.col("first.row") == F.col("row"), F.lit(True)).alias("is_first"),
    )
