"""Neighbour sums of vectors on a graph cut into blocks of nodes.

Nodes are numbered in the order of their degree and cut into blocks; a block's vectors travel as one row. Edges lie with
their source's block, in pieces of bounded size, each of which meets one copy of the block: what leaves a task is one sum
per target and piece, never a vector per edge. Sums of one block of targets are added in two steps, the first over salts
in proportion to the edges that come in, so no task takes more than its share of a hub's sums.

On a large graph vectors are cut into slices of some dimensions each, one pass of sums per slice. A block of short slices
holds more nodes, so more edges end in one sum before it moves, and what a pass moves is dropped before the next one. A
state then is one table per slice and the lengths of its vectors, which the next pass divides by.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popgraph.functions.skew import dense_index, join_measured, replicate, spread
from popgraph.operators.knn import _unit
from popgraph.session import cut_lineage, dropping_shuffles

BLOCK_BYTES = 4 << 20  # vectors of a block, the largest row that travels
PIECE_EDGES = 16_384  # edges of one block that one call takes
INTO_EDGES = 65_536  # edges whose sums one step-one group adds
GATHERED = 2048  # vectors gathered along edges at a time
PASS_BYTES = 1 << 30  # a vector per edge and slice, before sums: a graph beyond that is cut into slices
SLICE = 32  # dimensions of a slice, at least
BLOCK_SCHEMA = "block int, m binary"
PART_SCHEMA = "block int, salt int, pos binary, m binary"


class State:
    """One table (block, m) per slice, and (block, lengths) where the vectors still have to be divided by them."""

    def __init__(self, slices: list[DataFrame], lengths: DataFrame | None = None):
        self.slices, self.lengths = slices, lengths

    def divided(self, i: int) -> DataFrame:
        """Slice i as (block, m, lengths), without lengths if it needs none."""
        if self.lengths is None:
            return self.slices[i].withColumn("lengths", F.lit(None).cast("binary"))
        return join_measured(self.slices[i], self.lengths, "block", "block")


class BlockGraph:
    """Numbered nodes and the pieces of the edges of adj(src, dst), both directions."""

    def __init__(
        self, adj: DataFrame, dim: int, piece_edges: int | None = None, into_edges: int | None = None, block_rows: int | None = None,
        width: int | None = None,
    ):
        links = adj.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select("src", "dst")
        if width is None:
            slices = min(math.ceil(links.count() * dim * 8 / PASS_BYTES), dim // SLICE)
            width = math.ceil(dim / max(1, slices))
        # edges of a piece and sums of a group take as many bytes whatever the width
        piece_edges, into_edges = piece_edges or PIECE_EDGES * dim // width, into_edges or INTO_EDGES * dim // width
        rows = block_rows or max(1, BLOCK_BYTES // (8 * width))
        self.dim, self.rows, self.spark = dim, rows, adj.sparkSession
        self.cuts = [(lo, min(width, dim - lo)) for lo in range(0, dim, width)]
        with dropping_shuffles(self.spark):
            degrees = links.groupBy(F.col("src").alias("node")).agg((-F.count(F.lit(1))).alias("__less"))
            self.nodes = cut_lineage(dense_index(degrees, ["__less", "node"], "id").select("node", "id", (F.col("id") / rows).cast("int").alias("block"), (F.col("id") % rows).cast("int").alias("pos")))
            ids = self.nodes.select("node", "block", "pos")
            met = join_measured(links, ids.toDF("src", "block", "pos"), "src", "dst")
            met = join_measured(met, ids.toDF("dst", "to_block", "to_pos"), "dst", "src").select("block", "pos", "to_block", "to_pos")
            met = cut_lineage(met)
            self.salts = cut_lineage(met.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / F.lit(piece_edges)).cast("int").alias("n_salts")))
            into = met.groupBy(F.col("to_block").alias("into")).agg(F.ceil(F.count(F.lit(1)) / F.lit(into_edges)).cast("int").alias("n_into"))
            met = met.join(F.broadcast(into), F.col("to_block") == F.col("into")).drop("into")  # one row per block of nodes
            key = met.withColumn("to", F.struct("to_block", "to_pos"))
            pieces = self.salts.agg(F.coalesce(F.sum("n_salts"), F.lit(1))).first()[0]
            self.tasks = max(self.spark.sparkContext.defaultParallelism, pieces // 4)
            # in the order of the passes' keys, so that a pass moves no edge
            spreaded = spread(key, "block", "to", self.salts).drop("to").repartition(self.tasks, "block", "salt")
            self.edges = cut_lineage(spreaded.sortWithinPartitions("block", "salt"))

    def packed(self, vectors: DataFrame) -> State:
        """(node, v) as a state."""
        return self.packed_slices(lambda lo, n: vectors.select("node", F.slice("v", lo + 1, n).alias("v")))

    def packed_slices(self, vectors: Callable[[int, int], DataFrame]) -> State:
        """A state from (node, v) for n dimensions from lo on, asked for slice by slice."""
        with dropping_shuffles(self.spark):
            return State([self._pack(vectors(lo, n), n) for lo, n in self.cuts])

    def _pack(self, vectors: DataFrame, dim: int) -> DataFrame:
        rows = self.rows
        named = vectors.join(self.nodes, "node").select("block", F.lit(0).alias("salt"), "pos", "v")

        def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
                block = batch.column("block").to_numpy(zero_copy_only=False)
                pos = batch.column("pos").to_numpy(zero_copy_only=False)
                yield from _parts(block, np.zeros_like(block), pos, v)

        ordered = named.repartition("block").sortWithinPartitions("block")
        added = ordered.mapInArrow(parts, PART_SCHEMA).mapInArrow(lambda x: _added(x, rows, dim, False), PART_SCHEMA)
        return cut_lineage(added.select("block", "m"))

    def sums(self, state: State) -> State:
        """Per node the sum of its neighbours' vectors at unit length; a sum of zeros stays as it is."""
        with dropping_shuffles(self.spark):
            if len(self.cuts) == 1:
                return State([self._slice_sums(state, 0, self.dim, True)])
            slices = [self._slice_sums(state, i, n, False) for i, (_, n) in enumerate(self.cuts)]
            squares = None
            for one, (_, n) in zip(slices, self.cuts):
                part = one.mapInArrow(lambda x, n=n: _squares(x, n), LENGTH_SCHEMA)
                squares = part if squares is None else squares.unionByName(part)
            ordered = squares.repartition("block").sortWithinPartitions("block")
            return State(slices, cut_lineage(ordered.mapInArrow(_lengths, LENGTH_SCHEMA)))

    def _slice_sums(self, state: State, i: int, dim: int, unit: bool) -> DataFrame:
        rows = self.rows
        copies = replicate(state.divided(i).join(F.broadcast(self.salts), "block"))

        def along(key, left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:  # a salt may have no edge
                return pa.Table.from_batches([], schema=_PARTS)
            m = _divided(left.column("m")[0], left.column("lengths")[0], dim)
            pos, to_block, to_pos, n = (right.column(c).to_numpy() for c in ("pos", "to_block", "to_pos", "n_into"))
            salt = key[0].as_py() * 31 + key[1].as_py()
            return pa.Table.from_batches(list(_along(m, pos, to_block, to_pos, salt % n)), schema=_PARTS)

        keys = ["block", "salt"]
        sent = copies.groupBy(*keys).cogroup(self.edges.groupBy(*keys)).applyInArrow(along, PART_SCHEMA)
        for step, by in enumerate((["block", "salt"], ["block"])):
            ordered = sent.repartition(self.tasks, *by).sortWithinPartitions(*by)
            sent = ordered.mapInArrow(lambda x, last=unit and step == 1: _added(x, rows, dim, last), PART_SCHEMA)
            sent = sent if step else sent.withColumn("salt", F.lit(0))
        return cut_lineage(sent.select("block", "m"))

    def unpacked(self, states: list[tuple[float, State]]) -> DataFrame:
        """(node, embedding): the weighted sum of several states."""
        dim, rows, cuts = self.dim, self.rows, self.cuts
        every = None
        for turn, (w, state) in enumerate(states):
            for i in range(len(cuts)):
                one = state.divided(i).select("block", F.lit(turn).alias("turn"), F.lit(i).alias("slice"), F.lit(float(w)).alias("w"), "m", "lengths")
                every = one if every is None else every.unionByName(one)

        def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, held in _summed(batches, dim, cuts):
                for at in range(0, len(held), GATHERED):
                    v = held[at : at + GATHERED]
                    ids = np.arange(at, at + len(v), dtype="int64") + block * rows
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype="int32") * dim), pa.array(v.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(ids), lists], names=["id", "embedding"])

        ordered = every.repartition("block").sortWithinPartitions("block", "turn", "slice")
        vectors = ordered.mapInArrow(opened, "id bigint, embedding array<double>")
        return vectors.join(self.nodes.select("id", "node"), "id").select("node", "embedding")


LENGTH_SCHEMA = "block int, lengths binary"
_PARTS = pa.schema([("block", pa.int32()), ("salt", pa.int32()), ("pos", pa.binary()), ("m", pa.binary())])


def _part(block: int, salt: int, pos: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    values = [[int(block)], [int(salt)], [pos.astype("int32").tobytes()], [np.ascontiguousarray(v).tobytes()]]
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(values, _PARTS)], schema=_PARTS)


def _parts(block: np.ndarray, salt: np.ndarray, pos: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per run of equal block and salt."""
    cuts = np.flatnonzero((block[1:] != block[:-1]) | (salt[1:] != salt[:-1])) + 1
    for a, b in zip(np.append(0, cuts), np.append(cuts, len(block))):
        if b > a:
            yield _part(block[a], salt[a], pos[a:b], v[a:b])


def _along(m: np.ndarray, pos: np.ndarray, to_block: np.ndarray, to_pos: np.ndarray, salt: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums per target, the targets of one block in rows of their own; GATHERED vectors are gathered at a time."""
    order = np.lexsort((to_pos, to_block))
    pos, to_block, to_pos, salt = pos[order], to_block[order], to_pos[order], salt[order]
    first = np.flatnonzero(np.append(True, (to_block[1:] != to_block[:-1]) | (to_pos[1:] != to_pos[:-1])))
    sums = np.zeros((len(first), m.shape[1]))
    target = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(pos))))
    for a in range(0, len(pos), GATHERED):
        t = target[a : a + GATHERED]
        starts = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        sums[t[starts]] += np.add.reduceat(m[pos[a : a + GATHERED]], starts, axis=0)
    yield from _parts(to_block[first], salt[first], to_pos[first], sums)


def _added(batches: Iterator[pa.RecordBatch], rows: int, dim: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Parts in the order of their key, added up key by key; the last step returns unit vectors."""
    key = held = None
    everywhere = np.arange(rows, dtype="int32")

    def done() -> pa.RecordBatch:
        return _part(*key, everywhere, _unit(held) if last else held)

    for batch in batches:
        for block, salt, pos, m in zip(*(batch.column(i) for i in range(4))):
            now = (block.as_py(), salt.as_py())
            if now != key:
                if key is not None:
                    yield done()
                key, held = now, np.zeros((rows, dim))
            at = np.frombuffer(pos.as_buffer(), "int32")
            held[at] += np.frombuffer(m.as_buffer(), "float64").reshape(len(at), dim)  # a part names a target once
    if key is not None:
        yield done()


def _divided(m: pa.BinaryScalar, lengths: pa.BinaryScalar, dim: int) -> np.ndarray:
    v = np.frombuffer(m.as_buffer(), "float64").reshape(-1, dim)
    if not lengths.is_valid:
        return v
    n = np.frombuffer(lengths.as_buffer(), "float64")[:, None]
    return np.divide(v, n, out=v.copy(), where=n > 0)


def _length_row(block: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([values.tobytes()], pa.binary())], names=["block", "lengths"])


def _squares(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """What one slice adds to the squared lengths."""
    for batch in batches:
        for block, m in zip(batch.column("block"), batch.column("m")):
            v = np.frombuffer(m.as_buffer(), "float64").reshape(-1, dim)
            yield _length_row(block.as_py(), np.einsum("ij,ij->i", v, v))


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lengths from the squares of all slices, in the order of their block."""
    key = held = None
    for batch in batches:
        for block, squares in zip(batch.column("block"), batch.column("lengths")):
            now, part = block.as_py(), np.frombuffer(squares.as_buffer(), "float64")
            if key is not None and now != key:
                yield _length_row(key, np.sqrt(held))
            key, held = now, part if now != key else held + part
    if key is not None:
        yield _length_row(key, np.sqrt(held))


def _summed(batches: Iterator[pa.RecordBatch], dim: int, cuts: list[tuple[int, int]]) -> Iterator[tuple[int, np.ndarray]]:
    """(block, weighted sum) of rows (block, turn, slice, w, m, lengths) in the order of their block."""
    key = held = None
    for batch in batches:
        for block, i, w, m, lengths in zip(*(batch.column(c) for c in ("block", "slice", "w", "m", "lengths"))):
            lo, n = cuts[i.as_py()]
            v = w.as_py() * _divided(m, lengths, n)
            if block.as_py() != key:
                if key is not None:
                    yield key, held
                key, held = block.as_py(), np.zeros((len(v), dim))
            held[:, lo : lo + n] += v
    if key is not None:
        yield key, held
