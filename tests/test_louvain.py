"""Modularity communities against a plain version of the same moves, and their invariants."""

import hashlib
import random
from collections import defaultdict

import pytest

from popgraph.operators import algorithms as algo
from popgraph.operators import louvain as lv


def both(edges):
    edges = list(edges)
    return sorted({(a, b) for a, b in edges if a != b} | {(b, a) for a, b in edges if a != b})


def planted(seed=1, groups=6, size=12, inside=0.6, across=0.02):
    rng = random.Random(seed)
    nodes = [(g, f"n{g:02d}{i:02d}") for g in range(groups) for i in range(size)]
    return nodes, both((a, b) for i, (g, a) in enumerate(nodes) for h, b in nodes[:i] if rng.random() < (inside if g == h else across))


def modularity(edges, label):
    deg, inside, m = defaultdict(int), defaultdict(int), 0
    for (a, b), w in edges.items():
        deg[label[a]] += w
        inside[label[a]] += w if label[a] == label[b] else 0
        m += w
    return sum(inside[c] / m - (deg[c] / m) ** 2 for c in deg)


def connected_parts(nodes, edges, label):
    part, near = {}, defaultdict(list)
    for a, b in edges:
        if label[a] == label[b]:
            near[a].append(b)
    for n in sorted(nodes):
        todo = [n]
        while todo:
            x = todo.pop()
            if x not in part:
                part[x] = n
                todo += near[x]
    return part


def plain_level(edges, max_rounds):
    nodes = sorted({a for a, _ in edges})
    k, total = defaultdict(int), sum(edges.values())
    for (a, _), w in edges.items():
        k[a] += w
    label, moved = {n: n for n in nodes}, False
    for i in range(max_rounds):
        s, wish = defaultdict(int), {}
        for n in nodes:
            s[label[n]] += k[n]
        for n in nodes:
            near = defaultdict(int, {label[n]: 0})
            for (a, b), w in edges.items():
                if b == n and a != b:
                    near[label[a]] += w
            wish[n] = min((-(total * w - k[n] * (s[c] - (k[n] if c == label[n] else 0))), c != label[n], c) for c, w in near.items())[2]
        half = {n for n in nodes if hashlib.md5(f"{n}:{i}".encode()).hexdigest()[0] in "02468ace"}
        wishes = any(wish[n] != label[n] for n in nodes)
        moved |= any(wish[n] != label[n] for n in half)
        label = {n: wish[n] if n in half else label[n] for n in nodes}
        if not wishes:
            break
    return connected_parts(nodes, edges, label), moved


def plain_louvain(pairs, tolerance=1e-4, max_rounds=12, max_levels=10):
    edges = {p: 1 for p in pairs}
    whole, names = dict(edges), {a: a for a, _ in pairs}
    score, levels = modularity(whole, names), []
    for level in range(1, max_levels + 1):
        part, moved = plain_level(edges, max_rounds)
        if not moved:
            break
        after = {n: part[c] for n, c in names.items()}
        smaller = defaultdict(int)
        for (a, b), w in edges.items():
            smaller[part[a], part[b]] += w
        edges, now = dict(smaller), modularity(whole, after)
        if now <= score + 1e-12:
            break
        gain, names, score = now - score, after, now
        levels.append((level, len(set(names.values())), round(now, 9)))
        if gain <= tolerance:
            break
    return names, levels


def test_equals_plain_version(spark):
    _, pairs = planted()
    names, levels = lv.louvain(spark.createDataFrame(pairs, "src string, dst string"), max_rounds=5, max_levels=2, rows_per_salt=5)
    want, want_levels = plain_louvain(pairs, max_rounds=5, max_levels=2)
    assert {r[0]: r[1] for r in names.collect()} == want
    assert [(a, b, round(c, 9)) for a, b, c in levels] == want_levels and len(levels) == 2


def test_finds_planted_groups_and_beats_label_propagation(spark):
    nodes, pairs = planted()
    adj = spark.createDataFrame(pairs, "src string, dst string")
    names, levels = lv.louvain(adj)
    found = {r[0]: r[1] for r in names.collect()}
    groups = defaultdict(set)
    for g, n in nodes:
        groups[g].add(found[n])
    assert all(len(c) == 1 for c in groups.values()) and len(set(found.values())) == 6
    edges = {p: 1 for p in pairs}
    assert connected_parts(found, edges, found) == found
    spread = {r[0]: r[1] for r in algo.communities(adj).collect()}
    assert levels[-1][2] >= modularity(edges, spread) - 1e-12
    assert abs(levels[-1][2] - modularity(edges, found)) < 1e-12


def test_weights_loops_and_no_edges(spark):
    heavy = [("a", "b", 10), ("c", "d", 10), ("b", "c", 1), ("a", "a", 4)]
    rows = [(*e,) for e in heavy] + [(b, a, w) for a, b, w in heavy if a != b]
    names, levels = lv.louvain(spark.createDataFrame(rows, "src string, dst string, w bigint"))
    assert {r[0]: r[1] for r in names.collect()} == {"a": "a", "b": "a", "c": "c", "d": "c"}
    assert lv.quality(spark.createDataFrame(rows, "src string, dst string, w bigint"), names.toDF("node", "label")).first()["modularity"] == pytest.approx(levels[-1][2])
    names, levels = lv.louvain(spark.createDataFrame([], "src string, dst string"))
    assert names.collect() == [] and levels == []
