"""Context-tree weighting of more than two bytes against direct recursion."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import brute
from popgraph.llm import ctw, registered
from popgraph.llm.common import kept, prepare


def deep_scores(rows, depth):
    counts = defaultdict(lambda: [0, 0])

    def steps(text):
        raw = b"\xff" * depth + brute.lower(text or "").encode() + b"\xff"
        for i in range(depth, len(raw)):
            node, context = 1, tuple(raw[i - 1 : i - depth - 1 : -1] if i > depth else raw[i - 1 :: -1])
            for k in range(8):
                bit = raw[i] >> (7 - k) & 1
                yield context, node, bit
                node = node << 1 | bit

    for doc, text in rows:
        if not brute.held_out(doc):
            for context, node, bit in steps(text):
                for d in range(depth + 1):
                    counts[context[:d], node][bit] += 1
    by_depth = defaultdict(list)
    for (context, node), ab in counts.items():
        by_depth[len(context)].append((context, node, *ab))
    below, odds = defaultdict(float), {}
    for d in range(depth, -1, -1):
        for context, node, a, b in by_depth[d]:
            own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
            s = below[context, node]
            odds[context, node] = math.exp(min(700, own - s))
            weighted = own if d == depth else max(own, s) + math.log1p(math.exp(-abs(own - s))) - math.log(2)
            if d:
                below[context[:-1], node] += weighted
    out = []
    for _, text in rows:
        total = 0.0
        for context, node, bit in steps(text):
            p = None
            for d in range(depth, -1, -1):
                a, b = counts.get((context[:d], node), (0, 0))
                est, beta = (b + 0.5) / (a + b + 1), odds.get((context[:d], node), 1.0)
                p = est if p is None else (beta * est + p) / (beta + 1)
            total += math.log10(p if bit else 1 - p)
        out.append(total)
    return out


def texts():
    rng = random.Random(6)
    some = ["the green tea ", "Öl und Wasser ", "the red tea\n", "aaaa", "x\x00y ", "tea"]
    rows = [(i, "".join(rng.choice(some) for _ in range(rng.randrange(0, 9)))) for i in range(40)]
    return rows + [(3, rows[3][1]), (None, "the tea"), (41, None), (50, "unseen qzqzqz"), (51, "")]


@pytest.mark.parametrize("depth,flush,piece", [(4, 1 << 22, 1 << 22), (5, 30, 7), (2, 50, 1 << 22)])
def test_deep_contexts(spark, monkeypatch, depth, flush, piece):
    prepare(spark)
    monkeypatch.setattr(ctw, "FLUSH_CODES", flush)
    monkeypatch.setattr(ctw, "PIECE", piece)
    rows = texts()
    docs = kept(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), "docs")
    got = sorted((r["doc_id"] or -1, r["text"] or "", round(r["score"], 3)) for r in ctw.score(docs, depth=depth).select("doc.*", "score").collect())
    want = sorted((d or -1, t or "", s) for (d, t), s in zip(rows, deep_scores(rows, depth)))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(g[2] == pytest.approx(w[2], rel=1e-5, abs=2e-3) for g, w in zip(got, want))


def test_registered_query_looks_back_five_bytes(spark, monkeypatch):
    asked, score = [], ctw.score
    monkeypatch.setattr(ctw, "score", lambda *a, depth=2, **k: asked.append(depth) or score(*a, depth=depth, **k))
    scored = registered.QUERIES["op9_ctw"](spark, "/root/testdata/sf0.001")
    deep = scored.where("held_out and n_tokens > 50").agg(F.avg("bits_per_byte")).first()[0]
    docs = registered.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    assert asked == [5] and deep < score(docs).where("held_out and n_tokens > 50").agg(F.avg("bits_per_byte")).first()[0]
