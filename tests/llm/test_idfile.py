"""Id coder and file of ids: exact round trips, and the library's own ids."""

import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from popgraph.llm import idcoder, idfile
from popgraph.llm.common import kept, prepare
from popgraph.sources.files import scratch_path

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [0, 1, 2, 127, 128, 257, 5000, 300_001])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 49_408, n), rng.integers(0, 3, n), np.zeros(n, dtype=int), np.minimum(rng.zipf(1.3, n), 49_407), np.arange(n) % 977):
        assert (idcoder.decode_block(idcoder.encode_block(ids, 49_408)) == ids).all()


def test_carries_and_vocabularies():
    rng = np.random.default_rng(0)
    for vocabulary in (1, 2, 300, 1 << 21):
        ids = rng.integers(0, vocabulary, 40_000)
        ids[rng.random(40_000) < 0.6] = vocabulary - 1
        assert (idcoder.decode_block(idcoder.encode_block(ids, vocabulary)) == ids).all()
    with pytest.raises(ValueError):
        idcoder.encode_block(np.array([5]), 5)


def test_orders_make_blocks_smaller():
    rng = np.random.default_rng(2)
    sizes = {}
    words = [rng.integers(0, 40_000, 6) for _ in range(200)]
    for name, ids in {"random": rng.integers(0, 40_000, 60_000), "skewed": np.minimum(rng.zipf(1.4, 60_000), 39_999),
                      "phrases": np.concatenate([words[i] for i in rng.integers(0, 200, 10_000)])}.items():
        sizes[name] = len(idcoder.encode_block(ids, 40_000))
    assert sizes["random"] < 60_000 * 2.2 and sizes["skewed"] < 60_000 * 1.1 and sizes["phrases"] < 60_000 * 0.5


def test_damage_is_noticed():
    block = idcoder.encode_block(np.arange(1000), 5000)
    for at in (3, 20, 40, len(block) - 1):
        with pytest.raises(ValueError):
            idcoder.decode_block(block[:at] + bytes([block[at] ^ 4]) + block[at + 1 :])
    for cut in (b"", block[:30], block[:-2]):
        with pytest.raises(ValueError):
            idcoder.decode_block(cut)


def library(text):
    return Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids


def difficult(seed=1, n=400):
    rng = random.Random(seed)
    parts = ["don't", "It's", "'S", "É", "é", "́", "Σας", "ΣΑΣ", "İ", "ſ", "ﬁ", "Ⅷ", "x²", "日本語", "한국어", "🙂", "a b", " ", " ", "\x1c", "\x85",
             "<|endoftext|>", "<|startoftext|>", "<|endoftext|>.", "word.", "word...", "(word)", "w.,", "'.", "12.", "3,5", "²,", "ñ!", "\t", "\r\n", "", "", "#", "≮", "=.", "A" * 70, "ß,", "Ünter;", "İ.", "xİ,", "\u0958.", "Ω.", "\u1112\u1161\u11ab."]
    return [rng.choice([" ", "  ", "\n", " \n"]).join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_words_have_the_librarys_ids():
    with open(TOKENIZER, "rb") as file:
        own = idfile.Encoder(file.read(), True)
    whole = Tokenizer.from_file(TOKENIZER)
    for text in difficult():
        want = whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), dtype="<u4").tolist() == want, text
        own.words = dict(list(own.words.items())[:100])


@pytest.mark.parametrize("block_ids", [idcoder.BLOCK_IDS, 90])
def test_round_trip(spark, block_ids):
    prepare(spark)
    docs = kept(spark.createDataFrame(brute.documents(), brute.DOCS).withColumnRenamed("row", "block").repartition(3), "docs")
    path = scratch_path(spark, "ids")
    idfile.write_ids(docs, path, TOKENIZER, 1, block_ids=block_ids)
    pieces = idfile.read_ids(spark, path)
    got = idfile.documents_of(pieces).orderBy("start").collect()
    rows = [(r["doc_id"], r["text"]) for r in idfile.numbered(docs).orderBy(F.col("doc_id").asc_nulls_last(), "__row").collect()]
    whole, start = Tokenizer.from_file(TOKENIZER), 0
    assert len(got) == len(rows)
    for r, (doc_id, text) in zip(got, rows):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [1]
        assert (r["key"], r["start"], r["n_tokens"]) == (doc_id, start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)
    assert pieces.count() == len(rows) if block_ids > 1000 else pieces.count() > len(rows) + 50


def test_no_documents(spark):
    prepare(spark)
    docs = kept(spark.createDataFrame([], "doc_id bigint, text string"), "docs")
    assert idfile.round_trip(docs, TOKENIZER, 1).collect() == []


def test_a_long_text(spark):
    prepare(spark)
    rng = random.Random(4)
    text = " ".join(rng.choice(["alpha", "Beta,", "gamma.", "12"]) for _ in range(300_000))
    docs = kept(spark.createDataFrame([(1, text), (2, None), (0, "x")], "doc_id bigint, text string"), "docs")
    got = {r["key"]: r for r in idfile.round_trip(docs, TOKENIZER, 1, block_ids=100_000).collect()}
    ids = library(text) + [1]
    assert (got[1]["start"], got[1]["n_tokens"], got[1]["ids_crc32"]) == (2, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
    assert got[2]["start"] == 2 + len(ids) and got[2]["n_tokens"] == 1
