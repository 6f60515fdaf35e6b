"""Operators against their plain definitions on a table of difficult documents."""

import hashlib
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from popgraph.llm import chat, ctw, decontaminate, jaccard, lines, mixing, quality, secrets, spans, suffix
from popgraph.llm.common import kept, numbered, prepare
from popgraph.llm.graphs import components


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    return kept(spark.createDataFrame(brute.documents(), brute.DOCS).repartition(3), "docs")


@pytest.fixture(scope="module")
def rows(docs):
    """(id, text) in the order of row numbers."""
    found = numbered(docs).orderBy("__row").collect()
    return [(r["doc_id"], r["text"]) for r in found]


@pytest.fixture(scope="module")
def empty(spark, docs):
    return kept(docs.where("false"), "docs")


def key(x):
    return tuple((v is None, str(v)) for v in x)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def test_secrets(docs, rows):
    found = secrets.scan_secrets(docs).select("doc.doc_id", "base_spans", "spans").collect()
    same([r[:2] for r in found], [(d, ",".join(brute.base_secrets(t))) for d, t in rows])
    for r in found:
        assert set(r[1].split(",")) <= set(r[2].split(",")) or not r[1]


def test_secrets_by_token_efficiency(spark):
    texts = {
        "key is xK9vQ2mZr7TpLw4Jd8NfYb3HsGc6 ok": "tokens:7:35", "sha d41d8cd98f00b204e9800998ecf8427e": "hex:4:36",
        "id 123e4567-e89b-12d3-a456-426614174000": "", "some_rather_long_identifier_name_here": "", "internationalization/localization": "",
        "12345678901234567890123": "",
    }
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    found = {r[0]: r[1] for r in secrets.scan_secrets(frame).select("doc.text", "spans").collect()}
    assert found == texts


def test_spans(docs, rows):
    found = spans.drop_repeated_spans(docs)
    same(found.select("doc.doc_id", "n_sentences", "n_removed").collect(), brute.span_removal(rows))
    for r in found.select("doc.text", "removed", "kept_text").collect():
        text = r[0]
        for s in reversed(r[1]):
            text = text[: s["start"]] + text[s["end"] :]
        assert text == r[2]


@pytest.mark.parametrize("length,hot", [(200, 20_000), (40, 20_000), (40, 1)])
def test_suffix(docs, rows, length, hot):
    found = suffix.remove_repeats(docs, length=length, hot=hot)
    got = [(r[0], r[1], r[1] - len(r[3]), len(r[2]), hashlib.sha256(r[3]).hexdigest()) for r in found.select("doc.doc_id", "n_bytes", "removed", "kept").collect()]
    want = brute.removed_bytes([t for _, t in rows], length)
    same(got, [(d, *w) for (d, _), w in zip(rows, want)])


def test_suffix_in_pieces(docs, rows, monkeypatch):
    length, texts = 20, ["ab" * 50 + "x" + "abcabd" * 30, "zz" + "abcabd" * 20, "qrstuvw" * 10 + "é" * 40]
    for piece in (7, 64, 1 << 20):
        got = set()
        parts = []
        for k, text in enumerate(texts):
            raw = text.encode()
            for at in range(0, len(raw) - length + 1, piece):
                b = np.frombuffer(raw, dtype=np.uint8, count=min(piece + length - 1, len(raw) - at), offset=at)
                for right, whole, t, least, most in zip(*(x.tolist() for x in suffix.tuples(b, len(b) - length + 1, length, 2))):
                    parts += [(k, t + at - o) for o in range(least, most + 1)]
                    got.add(right)
        assert sorted(parts) == [(k, p) for k, t in enumerate(texts) for p in range(len(t.encode()) - length + 1)]


def test_lines(docs, rows):
    found = lines.drop_template_lines(docs).select("doc.doc_id", "kept_text", "doc.kept").collect()
    same([r[:2] for r in found], zip([d for d, _ in rows], brute.template_lines(rows)))
    assert {r[2] for r in found} == {"x"}


@pytest.mark.parametrize("n,percent,hot,spare", [(3, 90, 64, 0.25), (5, 80, 64, 0.25), (3, 90, 1, 0.25), (2, 60, 2, 0.0), (1, 50, 3, 0.5)])
def test_jaccard(docs, rows, monkeypatch, n, percent, hot, spare):
    monkeypatch.setattr(jaccard, "SPARE", spare)
    found = jaccard.join_sets(docs, n, percent, hot=hot)
    same(found.select("id", "n_shingles", "component_id").collect(), brute.jaccard_components(rows, n, percent))


def test_jaccard_keeps_one_of_each(docs, rows):
    found = jaccard.join_sets(docs, 5, 80).where("is_first").select("component_id").collect()
    assert len(found) == len({root for _, _, root in brute.jaccard_components(rows, 5, 80, roots=True)})


def test_jaccard_cells_meet(spark, docs, rows, monkeypatch):
    """Clusters cut into chunks find the same links."""
    prepare(spark)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(w if rng.random() > 0.02 else f"v{rng.randint(0, 9)}" for w in base) for _ in range(60)]
    many = kept(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "docs")
    monkeypatch.setattr(jaccard, "CELL_SETS", 10)
    monkeypatch.setattr(jaccard, "WIDE_SETS", 16)
    found = jaccard.join_sets(many, 3, 80).select("id", "n_shingles", "component_id").collect()
    same(found, brute.jaccard_components(list(enumerate(texts)), 3, 80))


def test_rtree_links_equal_all_pairs():
    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(0, 1 << 62, 80, dtype=np.uint64)) for _ in range(30)]
    sets = [np.unique(np.concatenate([b[rng.random(len(b)) > 0.06], rng.integers(0, 1 << 62, rng.integers(0, 6), dtype=np.uint64)])) for b in base for _ in range(12)]

    def labels(pairs):
        label = list(range(len(sets)))
        for _ in range(len(sets)):
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        return label

    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
    found = jaccard.cell_links(sets, 85)
    assert labels(found) == labels(pairs) and len(found) < len(sets)


def test_components(spark):
    prepare(spark)
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(300) if i % 50] + [(rng.randint(400, 480), rng.randint(400, 480)) for _ in range(60)] + [(7, 7), (None, 3)]
    label = {}
    for _ in range(400):
        for a, b in edges:
            if a is not None and a != b:
                label[a] = label[b] = min(label.get(a, a), label.get(b, b))
    found = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r[0]: r[1] for r in found} == label and len(found) == len(label)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_mixing(docs, rows):
    mixed, targets = mixing.mix(docs, block_words=8)
    got = {r["source"]: r for r in targets.collect()}
    sizes = {}
    for r in docs.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(brute.words(r["text"]))
    want = brute.targets(sizes)
    assert {s: r["source_size"] for s, r in got.items()} == sizes
    assert all(abs(got[s]["target"] - want[s]) < 1e-6 for s in want)
    taken = {r[0]: r[1] for r in mixed.groupBy("source").agg(F.sum("n_words")).collect()}
    assert all(abs(taken.get(s, 0) - want[s]) <= 8 * 3 for s in want)
    per = mixed.groupBy("row").agg(F.sum("n_words").alias("n"), F.first("doc_id").alias("d")).collect()
    size = {r["__row"]: len(brute.words(r["text"])) for r in numbered(docs).collect()}
    assert all(r["n"] <= 2 * size[r["row"]] for r in per)
    again, _ = mixing.mix(docs, block_words=8)
    assert sorted(map(str, mixed.collect())) == sorted(map(str, again.collect()))
    texts = mixing.materialise(mixed, docs).collect()
    assert len(texts) == mixed.count() and all(len(brute.words(r["text"])) == r["n_words"] for r in texts)
    whole = {(d, tuple(brute.words(t))) for d, t in rows}
    for r in texts:
        part = tuple(r["text"].split(" "))
        assert any(d == r["doc_id"] and w[r["first_word"] : r["first_word"] + r["n_words"]] == part for d, w in whole)
    blocks = {}
    for r in texts:
        blocks.setdefault((r["shard"], r["source"], r["slot"]), []).append((r["in_block"], r["n_words"]))
    for parts in blocks.values():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at <= 8


def test_permutation():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        j = np.arange(n)
        assert sorted(mixing.permute(j, np.full(n, n), np.full(n, 12345))) == list(range(n))
    counts = mixing.draw_counts([100, 0, 7, 1000], 9, 1)
    assert counts.sum(axis=0).tolist() == [100, 0, 7, 1000] and counts.sum(axis=1).max() - counts.sum(axis=1).min() <= 1


def test_quality(docs, rows):
    judged = quality.judge(docs)
    got = judged.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    same(got, [(d, *brute.base_quality(t)) for d, t in rows])
    assert judged.where("kept and base_failed").count() == 0
    assert judged.where("kept").count() > 40


def test_quality_distances(docs):
    judged = quality.judge(docs).select("doc.text", "doc.lang", "char_distance", "word_distance", "base_failed", "kept").collect()
    want = dict(zip([(r[0], r[1]) for r in judged], brute.quality_distances([(r[0], r[1]) for r in judged])))
    for r in judged:
        expected = want[r[0], r[1]]
        assert tuple(r[2:4]) == (pytest.approx(expected) if expected[0] is not None else (None, None))
        fits = expected[0] is None or (expected[0] <= quality.MAX_CHAR_DISTANCE and expected[1] <= quality.MAX_WORD_DISTANCE)
        assert r[5] == (fits and not r[4])


def test_quality_many_repeats(spark):
    """Both ways of finding repeated windows."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefghijklmnop"[:k]) for _ in range(n)) for k, n in ((2, 60), (5, 300), (9, 2000), (16, 3000), (16, 40))]
    frame = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string")
    got = {r[0]: r[1] for r in quality.measure(frame).select("text", "__n_repeat_words").collect()}
    assert got == {t: brute.base_quality(t)[4] for t in texts}


@pytest.mark.parametrize("block_words", [500_000, 10])
def test_decontaminate(spark, docs, rows, block_words):
    rng = random.Random(8)
    texts = [t for _, t in rows if t and len(brute.words(t)) > 40]
    items = [(i, " ".join(brute.words(rng.choice(texts))[3 : 3 + n]).upper()) for i, n in enumerate([13, 14, 30, 5, 2, 1, 13])]
    items += [(20, items[2][1]), (21, None), (22, "..."), (100, "nothing of this occurs in any of the texts at all surely not here"), (None, texts[0])]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.find_benchmark(docs, table, block_words=block_words)
    found = found.withColumn("bad", decontaminate.contaminated()).select("doc.doc_id", "n_words", "n_hit", "items", "bad", "doc.kept")
    got = [(r[0], r[1], r[2], len(r[3]), hashlib.sha256(",".join(r[3]).encode()).hexdigest(), r[4]) for r in found.collect()]
    known = [i for i in items if i[0] is not None]
    same(got, [(d, *brute.benchmark_hits(t, known)) for d, t in rows])
    assert sum(r[2] > 0 for r in got) > 3


@pytest.mark.parametrize("top", [200_000, 20])
def test_ctw(docs, rows, top):
    scored = ctw.score(docs, top_words=top).select("doc.doc_id", "doc.text", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    want = {}
    for (d, t), u, s in zip(rows, brute.unigram(rows), brute.context_tree(rows)):
        want[d, t] = (brute.held_out(d), *u, s)
    assert len(scored) == len(rows)
    for r in scored:
        held, tokens, known, train, base, score = want[r["doc_id"], r["text"]]
        assert tuple(r)[2:6] == (held, tokens, known, train)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-5)


def test_ctw_learns(docs):
    """Held-out texts cost fewer bits a byte than eight."""
    scored = ctw.score(docs).where("held_out and n_tokens > 50").agg(F.avg("bits_per_byte")).first()[0]
    assert scored < 5


def test_chat(spark):
    prepare(spark)
    control = "</s>[INST] ok [/INST]"
    tricky = ["[\\INST]", "[", "<s", "\\", "[/INST", "<role x>", "</role>", "<<s>>", "[[INST]]", "a\\b[\\\\/INST] </s>", ""]
    rows = [(1, 1, "user", "hi"), (1, 2, "assistant", control), (2, 1, "assistant", "x"), (3, 1, "system", None), (3, 2, "user", "a\nb"),
            (3, 3, "assistant", "é"), (4, 1, "tool <x>", "y"), (4, 2, None, "z"), (None, 1, "user", "q"), (5, 1, "user", "same"), (5, 1, "user", "same")]
    rows += [(10 + i, t, role, text) for i, text in enumerate(tricky) for t, role in enumerate(["user", "assistant"])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, n_turns bigint")
    segments = chat.format_chat(frame)
    got = {r[0]: r for r in chat.read_back(segments).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        turns = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        spoken = "".join(t for role, t in turns if role == "assistant")
        digest = hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert tuple(got[conv])[1:5] == (len(turns), digest, len(spoken), hashlib.sha256(spoken.encode()).hexdigest())
    assert {c for c in got if got[c]["valid"]} == {1, 3, *range(10, 10 + len(tricky))}
    assert chat.read_back(chat.format_chat(frame.where("false"))).count() == 0


def test_empty_tables(spark, empty):
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert secrets.scan_secrets(empty).count() == 0
    assert spans.drop_repeated_spans(empty).count() == 0
    assert suffix.remove_repeats(empty).count() == 0
    assert lines.drop_template_lines(empty).count() == 0
    assert jaccard.join_sets(empty).count() == 0
    mixed, targets = mixing.mix(empty)
    assert mixing.materialise(mixed, empty).count() == 0 and targets.count() == 0
    assert quality.judge(empty).count() == 0
    assert decontaminate.find_benchmark(empty, items).count() == 0
    assert ctw.score(empty).count() == 0


def test_no_training_texts(spark):
    prepare(spark)
    held = [i for i in range(50) if brute.held_out(i)][:2]
    one = kept(spark.createDataFrame([(i, "ab") for i in held], "doc_id bigint, text string"), "docs")
    r = ctw.score(one).collect()
    assert len(r) == 2 and r[0]["n_known"] == 0 and r[0]["score"] == pytest.approx(3 * np.log10(1 / 256), rel=1e-5)


def test_decontaminate_without_items(spark, docs, rows):
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.find_benchmark(docs, items).where("n_hit = 0").count() == len(rows)


@pytest.mark.parametrize("copies", [50, 250])
def test_near_copies_give_few_edges(spark, copies):
    """Groups of near copies reach `components` with about one edge a set."""
    prepare(spark)
    rng = random.Random(copies)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(4000)]
    base, texts = [rng.choice(words) for _ in range(300)], []
    for _ in range(copies):
        own = list(base)
        for at in rng.sample(range(300), 3):
            own[at] = rng.choice(words)
        texts.append(" ".join(own))
    table = kept(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "docs")
    own = jaccard.sizes_and_classes(numbered(table), 5, "text", "doc_id")
    classes = kept(own.groupBy("k1", "k2", "size").agg(F.min("row").alias("rep"), F.first("counts").alias("counts")), "classes")
    seen = {}
    spy = lambda edges: seen.setdefault("edges", edges.distinct().count()) and components(edges)
    before, jaccard.components = jaccard.components, spy
    try:
        found = jaccard.clusters(table, classes, 5, 80, "text", jaccard.HOT)
        assert found.count() == copies and found.select("cluster").distinct().count() == 1
    finally:
        jaccard.components = before
    assert seen["edges"] <= 1.5 * copies
