"""Token ids of a corpus in a binary file format, and back.

`write_ids` encodes every text, appends an end id, and writes the ids in the order of the documents' keys; `read_ids`
reads the files back. The format: a Parquet table whose rows are blocks of at most BLOCK_IDS consecutive ids, each coded
on its own by `idcoder` and checksummed, with the list of the documents that have ids in it. Rows carry the shard
(partition of the sorted corpus), the number of the block in it, and the place of its first id in the shard. Any block can
be read alone; a task holds one block and one text at a time, and a lost one is written again by Spark.

The corpus is sorted once, texts and all, in ranges of keys; encoding and coding happen where a range lies, so nothing but
blocks leaves a task. Only the pieces of documents that cross a block's border are brought together when read.

Tokenizers of the given kind drop white space and split at it, so a text is encoded word by word: different words once
per worker, kept in a dictionary of at most CACHE_WORDS words, which is emptied when it is full. `by_word=False`
encodes whole texts instead, for tokenizers whose tokens may cross a blank.

Defined cases: a null text is empty and has the end id alone; documents with equal keys go by their place in the table;
null keys come last; an empty table gives no blocks; of other columns nothing is kept; a damaged block raises an error.
"""

from __future__ import annotations

import hashlib
import os
import sys
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popgraph.llm import idcoder
from popgraph.llm.common import kept, numbered, prepare
from popgraph.sources.files import scratch_path

CACHE_WORDS = 600_000
LONG_WORD = 64
TAIL = ".,;:!?*#\"()"  # runs of these behind a letter are tokens of their own
MAX_TOKENIZER_BYTES = 64 << 20
FILE = (
    "shard int, number bigint, start bigint, n_ids bigint, "
    "documents array<struct<key: bigint, row: bigint, n_ids: bigint, is_first: boolean, is_last: boolean>>, block binary"
)
PIECE = "shard int, number bigint, key bigint, row bigint, start bigint, is_first boolean, is_last boolean, ids binary"

_encoders: dict[tuple[bytes, bool], Encoder] = {}


def packed(ids: list[int]) -> bytes:
    numbers = array("I", ids)
    if sys.byteorder != "little":
        numbers.byteswap()
    return numbers.tobytes()


class Encoder:
    """Ids of texts as little-endian 32-bit numbers."""

    def __init__(self, raw: bytes, by_word: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.by_word = Tokenizer.from_str(raw.decode()), by_word
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.words: dict[str, bytes] = {}
        self.letters = self.letter_table()

    def letter_table(self) -> dict[int, str]:
        """What the normaliser and the splitter make of each letter up to U+00FF; letters they treat otherwise are left out.

        A word of such letters is one token string for the model, so it goes to the model directly.
        """
        normal, split = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        if not (self.by_word and normal and split):
            return {}
        table = {}
        for code in range(0x100):
            c = chr(code)
            pair = split.pre_tokenize_str(normal.normalize_str(c + "a" + c)) if c.isalpha() else []
            alone = split.pre_tokenize_str(normal.normalize_str(c)) if c.isalpha() else []
            if len(pair) == len(alone) == 1 and pair[0][0] == alone[0][0] + "a" + alone[0][0]:
                table[code] = alone[0][0]
        return table

    def of_letters(self, words: list[str]) -> dict[str, bytes]:
        """Ids of those words that consist of such letters; words the splitter makes the same of are encoded once."""
        model, letters, done, out = self.tokenizer.model, self.letters, {}, {}
        for word in words:
            if word.isalpha() and max(word) < "\u0100" and all(map(letters.__contains__, map(ord, word))):
                form = word.translate(letters)
                if form not in done:
                    done[form] = packed([t.id for t in model.tokenize(form)])
                out[word] = done[form]
        return out

    def plain(self, texts: list[str]) -> list[bytes]:
        return [packed(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: set[str]) -> None:
        """Encode words that are not known; a letter followed by marks only is the word, then the marks."""
        if len(self.words) > CACHE_WORDS:
            self.words = {}
        cores, whole = {}, []
        for word in words:
            core = word.rstrip(TAIL)
            if core and core is not word and core[-1].isalpha() and core[-1] < "\u0100":  # no normaliser makes a mark of these
                cores[word] = core, word[len(core) :]
            else:
                whole.append(word)
        need = {part for pair in cores.values() for part in pair if part not in self.words}
        whole = [*whole, *need.difference(whole)]
        known = self.of_letters(whole)
        rest = [w for w in whole if w not in known]
        self.words.update(known)
        self.words.update(zip(rest, self.plain(rest)))
        self.words.update((word, self.words[core] + self.words[tail]) for word, (core, tail) in cores.items())

    def encode(self, text: str) -> bytes:
        if not self.by_word:
            return self.plain([text])[0]
        words = text.replace("\n", " ").split(" ")
        found = list(map(self.words.get, words))
        if None in found:
            self.learn({w for w, f in zip(words, found) if f is None and len(w) <= LONG_WORD})
            known = self.words
            found = [f if f is not None else known[w] if len(w) <= LONG_WORD else self.plain([w])[0] for w, f in zip(words, found)]
        return b"".join(found)


def encoder(raw: bytes, by_word: bool) -> Encoder:
    """One per Python worker and tokenizer."""
    key = hashlib.sha256(raw).digest(), by_word
    if key not in _encoders:
        _encoders[key] = Encoder(raw, by_word)
    return _encoders[key]


def _blocks(batches, own: Encoder, end_id: int, block_ids: int):
    """Rows of the file from (shard, key, row, text) in order."""
    vocabulary, end = max(own.vocabulary, end_id + 1), np.array([end_id], dtype="<u4").tobytes()
    buffer, documents, size, number, start, shard = [], [], 0, 0, 0, 0

    def flush():
        ids = np.frombuffer(b"".join(buffer), dtype="<u4")
        row = (shard, number, start, len(ids), documents, idcoder.encode_block(ids, vocabulary))
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, ARROW.types)], schema=ARROW)

    for batch in batches:
        for shard, key, row, text in zip(*(batch.column(c) for c in ("shard", "key", "row", "text"))):
            shard, key, row = shard.as_py(), key.as_py(), row.as_py()
            ids, at = own.encode(text.as_py() or "") + end, 0
            while at < len(ids):
                piece = ids[at : at + 4 * (block_ids - size)]
                documents.append({"key": key, "row": row, "n_ids": len(piece) // 4, "is_first": at == 0, "is_last": at + len(piece) == len(ids)})
                buffer.append(piece)
                size, at = size + len(piece) // 4, at + len(piece)
                if size == block_ids:
                    yield flush()
                    buffer, documents, size, number, start = [], [], 0, number + 1, start + size
    if size:
        yield flush()


_long = pa.int64()
ARROW = pa.schema([
    ("shard", pa.int32()), ("number", _long), ("start", _long), ("n_ids", _long),
    ("documents", pa.list_(pa.struct([("key", _long), ("row", _long), ("n_ids", _long), ("is_first", pa.bool_()), ("is_last", pa.bool_())]))),
    ("block", pa.binary()),
])
ARROW_PIECE = pa.schema([
    ("shard", pa.int32()), ("number", _long), ("key", _long), ("row", _long), ("start", _long), ("is_first", pa.bool_()), ("is_last", pa.bool_()),
    ("ids", pa.binary()),
])


def write_ids(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", by_word: bool = True,
    block_ids: int = idcoder.BLOCK_IDS,
) -> None:
    """Write the ids of `docs`, a table of Parquet files, to the folder `path`.

    `tokenizer` is the path of a tokenizers file on the driver; its bytes, at most MAX_TOKENIZER_BYTES, are broadcast.
    """
    spark = prepare(docs.sparkSession)
    if os.path.getsize(tokenizer) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"{tokenizer} is larger than {MAX_TOKENIZER_BYTES} bytes")
    with open(tokenizer, "rb") as file:
        raw = spark.sparkContext.broadcast(file.read())
    rows = numbered(docs).select(F.col(key).cast("bigint").alias("key"), F.col("__row").alias("row"), F.col(text).alias("text"))
    order = [F.col("key").asc_nulls_last(), F.col("row")]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("shard"), "key", "row", "text")

    def run(batches):
        return _blocks(batches, encoder(raw.value, by_word), end_id, block_ids)

    sorted_rows.mapInArrow(run, FILE).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(shard, number, key, row, start, is_first, is_last, ids): a row per document and block, in the order of the file.

    `ids` are little-endian unsigned 32-bit numbers, `start` the ids of the whole corpus before the piece.
    """
    table = spark.read.schema(FILE).parquet(path)
    # one number per shard
    totals = sorted((r[0], r[1]) for r in table.groupBy("shard").agg(F.sum("n_ids")).collect())
    before, first = [], 0
    for shard, n in totals:
        before.append((shard, first))
        first += n
    offsets = spark.createDataFrame(before, "shard int, before bigint")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                raw, at, out = idcoder.decode_block(row["block"]).tobytes(), 0, []
                for d in row["documents"]:
                    out.append((row["shard"], row["number"], d["key"], d["row"], row["start"] + at // 4, d["is_first"], d["is_last"], raw[at : at + 4 * d["n_ids"]]))
                    at += 4 * d["n_ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), ARROW_PIECE.types)], schema=ARROW_PIECE)

    pieces = table.mapInArrow(run, PIECE)
    return pieces.join(F.broadcast(offsets), "shard").withColumn("start", F.col("start") + F.col("before")).drop("before")


def documents_of(pieces: DataFrame) -> DataFrame:
    """(key, row, start, n_tokens, ids_crc32) per document from the pieces that `read_ids` returns."""
    whole = F.col("is_first") & F.col("is_last")
    counted = kept(pieces.select(
        "key", "row", "shard", "number", "start", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"),
        F.when(~whole, F.col("ids")).alias("part"),
    ), "pieces")
    parts = F.array_sort(F.collect_list(F.struct("start", "part")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["part"]))
    split = counted.where("part IS NOT NULL").groupBy("row", "key").agg(
        F.min("start").alias("start"), F.sum("n_tokens").alias("n_tokens"), F.crc32(joined).alias("ids_crc32")
    )
    columns = ["key", "row", "start", "n_tokens", "ids_crc32"]
    return counted.where("part IS NULL").select(*columns).unionByName(split.select(*columns))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, **options) -> DataFrame:
    """Write `docs` to the cluster's shared folder and read them back as `documents_of`."""
    path = scratch_path(docs.sparkSession, "ids")
    write_ids(docs, path, tokenizer, end_id, **options)
    return documents_of(read_ids(docs.sparkSession, path))
