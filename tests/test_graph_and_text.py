import itertools
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from popgraph.functions import skew
from popgraph.operators import algorithms as algo
from popgraph.operators import conversation as conv
from popgraph.operators import knn, leakage, paths
from popgraph.streaming import sessions


def adj(spark, pairs):
    both = [(str(a), str(b)) for a, b in pairs] + [(str(b), str(a)) for a, b in pairs]
    return spark.createDataFrame(both, "src string, dst string")


RING = [(i, i + 1) for i in range(9)] + [(3, 7), (20, 21), (21, 22)]


def neighbours(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(str(a), set()).add(str(b))
        out.setdefault(str(b), set()).add(str(a))
    return out


def brandes(graph):
    score = dict.fromkeys(graph, 0.0)
    for s in graph:
        dist, sigma, order, pred = {s: 0}, {s: 1.0}, [], {}
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in graph[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] = sigma.get(w, 0) + sigma[v]
                    pred.setdefault(w, []).append(v)
        delta = dict.fromkeys(graph, 0.0)
        for w in reversed(order):
            for v in pred.get(w, []):
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                score[w] += delta[w]
    return {k: v / 2 for k, v in score.items()}


def test_betweenness_equals_brandes(spark):
    got = {r["node"]: r["betweenness"] for r in algo.betweenness(adj(spark, RING), 1000).collect()}
    want = brandes(neighbours(RING))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_components_and_communities(spark):
    graph = neighbours(RING)
    a = adj(spark, RING)
    nodes = spark.createDataFrame([(n,) for n in [*graph, "alone"]], "node string")
    got = {r["node"]: r["comp"] for r in algo.components(nodes, a).collect()}
    assert len({got[str(i)] for i in range(10)}) == 1 and got["alone"] == "alone" and got["20"] == got["22"] != got["1"]
    ratio = algo.largest_component_ratio(nodes, a, spark.createDataFrame([("3",)], "node string")).first()
    assert ratio["remaining"] == 13 and ratio["largest"] == 6
    comm = {r["node"]: r["community_id"] for r in algo.communities(a).collect()}
    for label in set(comm.values()):
        members = {n for n in comm if comm[n] == label}
        seen, queue = {min(members)}, [min(members)]
        while queue:
            for w in graph[queue.pop()] & members - seen:
                seen.add(w)
                queue.append(w)
        assert seen == members


def test_long_chain_settles(spark):
    chain = [(f"{i:04d}", f"{i + 1:04d}") for i in range(70)]
    nodes = spark.createDataFrame([(f"{i:04d}",) for i in range(71)], "node string")
    rows = algo.components(nodes, adj(spark, chain)).select("comp").distinct().collect()
    assert [r["comp"] for r in rows] == ["0000"]


def test_salted_hub_gives_the_same_ranks(spark):
    star = [("hub", f"n{i}") for i in range(50)] + [(f"n{i}", f"n{i + 1}") for i in range(0, 40, 2)]
    a = adj(spark, star)
    plain = {r["node"]: r["rank"] for r in algo.pagerank(a, 3).collect()}
    salted = {r["node"]: r["rank"] for r in algo.pagerank(a, 3, rows_per_salt=7).collect()}
    assert plain.keys() == salted.keys() and all(abs(plain[k] - salted[k]) < 1e-12 for k in plain)
    g = algo.Graph(a, rows_per_salt=7)
    assert g.salts.where("src = 'hub'").first()["n_salts"] == 8
    assert g.send(g.nodes.select("node", F.lit(1).alias("x"))).count() == a.count()


def test_shortest_path(spark):
    a = adj(spark, RING)
    got = [r["node"] for r in paths.shortest_path(a, "1", "8", 6).orderBy("step").collect()]
    assert got == ["1", "2", "3", "7", "8"]
    assert paths.shortest_path(a, "1", "22", 6).isEmpty() and paths.shortest_path(a, "0", "9", 5).isEmpty()
    with pytest.raises(ValueError):
        paths.shortest_path(a, "1", "1", 3)


def test_removal_parameters(spark):
    a = adj(spark, RING)
    with pytest.raises(ValueError):
        algo.removal_impact(a, ["1", "1"], 1)
    assert algo.removal_impact(a, ["unknown"], 1).first()["path_found"] is False


def test_knn_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8)) * 4
    v = np.vstack([centres[i % 6] + rng.normal(size=8) for i in range(240)])
    v[:90] = v[0] + rng.normal(size=(90, 8)) * 0.01
    df = spark.createDataFrame([(f"{i:03d}", x.tolist()) for i, x in enumerate(v)], "uuid string, embedding array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 9)
    np.fill_diagonal(sims, -9)
    got = {}
    for r in knn.neighbours(df, 4, block_rows=16).collect():
        got.setdefault(int(r["src"]), {})[r["rnk"]] = r["score"]
    for i in range(len(v)):
        want = sorted(sims[i], reverse=True)[:4]
        assert np.allclose([got[i][k] for k in (1, 2, 3, 4)], want, atol=1e-8)


def test_hashed_rank_and_dense_index(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id").cast("string").alias("x"))
    rows = skew.hashed_row_number(df, ["k"], F.md5("x"), "r", total="n").collect()
    for k in range(3):
        mine = sorted((r for r in rows if r["k"] == k), key=lambda r: r["r"])
        assert [r["r"] for r in mine] == list(range(1, mine[0]["n"] + 1))
        import hashlib
        keys = [hashlib.md5(r["x"].encode()).hexdigest() for r in mine]
        assert keys == sorted(keys)
    pos = skew.dense_index(df, ["x"], "pos").orderBy("x").collect()
    assert [r["pos"] for r in pos] == list(range(500))


def test_measured_join_both_ways(spark):
    big = spark.range(400).select(F.when(F.col("id") < 300, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    small = spark.createDataFrame([("hot", 1), ("301", 2), ("302", 3)], "k string, v int")
    a = {tuple(r) for r in skew.join_measured(big, small, "k", "id").collect()}
    b = {tuple(r) for r in skew.join_measured(big, small, "k", "id", max_bytes=0).collect()}
    assert a == b and len(a) == 302


def test_masking_literals(spark):
    def mask(text, names):
        return spark.createDataFrame([(text, names)], "t string, n array<string>").select(
            leakage.mask_names(F.col("t"), F.col("n")).alias("m"), leakage.passes_audit(leakage.mask_names(F.col("t"), F.col("n")), F.col("n")).alias("ok")).first()

    got = mask("주말 산책 그리고 YOGA, 홈요가", ["산책", "yoga"])
    assert got["m"] == "주말 [MASK] 그리고 [MASK], 홈요가" and got["ok"]
    kept = mask("산책을 좋아한다", ["산책"])
    assert kept["m"] == "산책을 좋아한다" and not kept["ok"]
    assert mask("동네 산책 코스 산책", ["산책", "동네 산책"])["m"] == "[MASK] 코스 [MASK]"


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(40)]
    texts = []
    for i in range(60):
        t = list(rng.choice(words[: 10 + i % 30], size=rng.integers(3, 15)))
        texts.append(("a" if i % 2 else "b", i, " ".join(t)))
        texts.append(("b" if i % 2 else "a", 1000 + i, " ".join(t[:-1] if i % 3 else t)))
    df = spark.createDataFrame(texts, "side string, key long, text string")
    once = {}
    for s, k, t in texts:
        once[(s, t)] = min(k, once.get((s, t), k))
    want = set()
    for (sa, ta), (sb, tb) in itertools.product(once, once):
        if sa == "a" and sb == "b":
            x, y = set(ta.split()), set(tb.split())
            if len(x & y) / len(x | y) > 0.8:
                want.add((once[(sa, ta)], once[(sb, tb)]))
    got = {(r["a"], r["b"]) for r in leakage.near_duplicates(df).collect()}
    assert got == want and want


@pytest.fixture
def talk(spark):
    texts = [
        "서울 30대 여성 보여줘", "그중 직업은 교사", "취미가 등산인 사람 찾아줘", "초기화", "부산 남성 분포 알려줘", "더 알려줘", "안녕", "그리고 또", "추천해줘",
    ]
    rows = [(1, 2 * i, "user", t) for i, t in enumerate(texts)] + [(1, 2 * i + 1, "assistant", "네") for i in range(len(texts))]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("block", [4096, 3])
def test_conversation_rules(talk, monkeypatch, block):
    monkeypatch.setattr(conv, "BLOCK", block)
    got = [r["intent"] for r in conv.intents(talk).orderBy("turn").collect()]
    assert got == ["search", "search", "stats", "reset", "stats", "stats", "general", "general", "general"]
    rows = conv.carried_filters(talk, conv.extract_filters(F.col("text"))).orderBy("turn").collect()
    assert (rows[2]["province"], rows[2]["age_group"], rows[2]["sex"], rows[2]["hobby"]) == ("서울", "30대", "여자", "등산")
    assert rows[1]["occupation"] == "교사" and rows[3]["province"] is None
    assert (rows[5]["province"], rows[5]["sex"], rows[5]["age_group"]) == ("부산", "남자", None)


def test_history_across_blocks(talk, monkeypatch):
    want = [tuple(r) for r in conv.history(talk).orderBy("turn").collect()]
    monkeypatch.setattr(conv, "BLOCK", 12)
    assert [tuple(r) for r in conv.history(talk).orderBy("turn").collect()] == want
    assert len(want[-1][3]) == 10


def test_stream_equals_batch(spark, talk, tmp_path):
    for i, lo in enumerate(range(0, 18, 6)):
        talk.where((F.col("turn") >= lo) & (F.col("turn") < lo + 6)).coalesce(1).write.mode("append").parquet(str(tmp_path / "talk"))
    stream = spark.readStream.schema(talk.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "talk"))
    extract = {k: v for k, v in conv.extract_filters(F.col("text")).items() if k in ("province", "sex", "hobby")}
    got = sessions.drain(sessions.carried_filters_stream(stream, extract, conv.RESET), "test").orderBy("turn")
    want = conv.carried_filters(talk, extract).select(*got.columns).orderBy("turn")
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]


def test_routes(spark):
    q = ["서울과 부산을 비교해줘", "30대는 몇 명이야", "조용한 카페를 좋아하는 사람"]
    df = spark.createDataFrame([(x,) for x in q], "t string").select(conv.route(F.col("t")).alias("r"))
    assert [r["r"] for r in df.collect()] == ["composite", "cypher", "vector"]


def test_knn_ties_go_by_id_and_packs_stay_bounded(spark, monkeypatch):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(500, 8))
    v[100:300] = v[100]  # copies: every tie is broken by the id
    df = spark.createDataFrame([(f"{i * 7 % 500:03d}", x.tolist()) for i, x in enumerate(v)], "uuid string, embedding array<double>")
    ids = np.array([f"{i * 7 % 500:03d}" for i in range(500)])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 9)
    want = {}
    for i in range(500):
        order = sorted((j for j in range(500) if j != i), key=lambda j: (-sims[i, j], ids[j]))[:5]
        want[ids[i]] = [ids[j] for j in order]
    got = {}
    for r in knn.neighbours(df, 5, block_rows=64).collect():
        got.setdefault(r["src"], {})[r["rnk"]] = r["dst"]
    assert {s: [d[n] for n in range(1, 6)] for s, d in got.items()} == want


def test_knn_keeps_vectors_out_of_its_visits(spark):
    """No row per vector and visited block: rows of the comparison are pairs of packs."""
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(f"{i:03d}", x.tolist()) for i, x in enumerate(rng.normal(size=(400, 16)))], "uuid string, embedding array<double>")
    plan = knn.neighbours(df, 3, block_rows=16)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "FlatMapCoGroups" not in plan
    missing = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), (None, [1.0, 0.5])], "uuid string, embedding array<double>")
    near = {(r["src"], r["rnk"]): r["dst"] for r in knn.neighbours(missing, 1).collect()}
    assert near == {("a", 1): None, ("b", 1): None, (None, 1): "a"} or near[("b", 1)] in (None, "a")


def test_knn_packs_of_a_partition(spark, monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(knn, "PACK_BYTES", 256 * 4 * 8)
    monkeypatch.setattr(knn.TaskContext, "get", classmethod(lambda cls: type("C", (), {"partitionId": lambda self: 3})()))
    rows = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(700)]), pa.array([[1.0, 2.0, 0.0, i] for i in range(700)])], names=["uuid", "embedding"])
    packs = list(knn._packs(iter([rows])))
    assert [len(p.column("ids")[0]) for p in packs] == [256, 256, 188] and [p.column("seq")[0].as_py() for p in packs] == [0, 1, 2]
