"""Kept indexes, similarity joins and communities against brute force, with hot groups, ties, nulls and empty tables."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.operators import graph as G
from lodestack.operators import leiden as L
from lodestack.operators import retrieval as R
from lodestack.operators import similar as S
from lodestack.sources import postings as P
from lodestack.sources import vector_index as V

DATA = "/root/testdata/sf0.001"


def vectors(n=900, dim=24, seed=3):
    rng = np.random.default_rng(seed)
    heads = rng.standard_normal((12, dim))
    rows = [(i, (heads[i % 12] + 0.5 * rng.standard_normal(dim)).tolist(), i % 5) for i in range(n)]
    rows += [(n + i, rows[7][1], 1) for i in range(n // 2)]  # a third of all rows are one vector
    return rows + [(2 * n, None, 1), (2 * n + 1, [0.0] * dim, 2)]


SCHEMA = "vec_id long, embedding array<double>, label int"


def test_vector_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "PART", 50)
    monkeypatch.setattr(V, "ASKED", 16)
    rows = spark.createDataFrame(vectors(), SCHEMA)
    index = V.VectorIndex.build(rows.filter("vec_id % 3 <> 0"), str(tmp_path / "i"), keep=("label",))
    index.add(rows.filter("vec_id % 3 = 0"))
    assert index.rows().count() == rows.filter("embedding is not null").count()
    asked = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    for where in (None, F.col("label") == 3, F.col("vec_id") < 4):
        exact = R.cosine_neighbours(rows if where is None else rows.filter(where), asked).collect()
        got = V.VectorIndex(spark, str(tmp_path / "i")).search(asked, where=where).collect()
        last = {r["query_id"]: r["score"] for r in sorted(exact, key=lambda r: r["rank"])}
        assert len(got) == len(exact) and len({(r["query_id"], r["vec_id"]) for r in got}) == len(got)
        assert sum(r["score"] >= last[r["query_id"]] for r in got) >= 0.9 * len(exact)
    with pytest.raises(Exception, match="dimension"):
        index.search(asked.limit(1).withColumn("embedding", F.array(F.lit(1.0)))).collect()
    assert index.search(asked.limit(0)).count() == 0
    none = V.VectorIndex.build(rows.limit(0), str(tmp_path / "none"))
    assert none.search(asked).count() == 0


def test_kept_postings_equal_bm25(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "SHARD", 40)
    monkeypatch.setattr(P, "BLOCK", 4)
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(r.choices(words, weights=[1 / (j + 1) for j in range(60)], k=r.randint(0, 40)))) for i in range(200)] + [(200, None), (201, ""), (202, "w0 " * 900), (7, "w1 w2 twice there")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(1, "w0 w0 w59"), (2, None), (3, "zzz"), (4, "w1 w2 w3 w4 w5 W6"), (5, " ".join(words))], "query_id long, text string")
    index = P.PostingsIndex.build(docs.filter("doc_id < 120"), str(tmp_path / "p"))
    index.add(docs.filter("doc_id >= 120"))
    same = lambda live, k: sorted(map(tuple, index.search(asked, k).collect())) == sorted(map(tuple, R.bm25(live, asked, k).select("query_id", "doc_id", "score", "rank").collect()))
    assert same(docs, 5) and same(docs, 250)
    index.remove(spark.createDataFrame([(7,), (202,), (999,)], "doc_id long"))
    index.remove(spark.createDataFrame([(7,), (9,)], "doc_id long"))
    live = docs.filter("doc_id not in (7, 9, 202)")
    assert same(live, 7)
    assert sorted(map(tuple, index.statistics().collect())) == sorted((x["term"], x["df"], x["tf"]) for x in R.document_frequencies(live).filter("term is not null").collect())
    read = index.search(asked, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "/forward" not in read and "text" not in read
    one = P.PostingsIndex.build(docs.limit(0), str(tmp_path / "none"))
    assert one.search(asked).count() == 0 and index.search(asked.limit(0)).count() == 0


def test_blocks_below_the_floor_are_not_scored():
    import pandas as pd

    n, looked = 200, []

    class Looked(np.ndarray):
        def __getitem__(self, i):
            if isinstance(i, slice):
                looked.append(i)
            return super().__getitem__(i)

    docs, tfs = np.arange(n).view(Looked), [9] * 8 + [1] * (n - 8)
    b = list(range(n // 2))
    rows = pd.DataFrame({"term": ["x", None], "docs": [docs, None], "tfs": [tfs, None], "b": [b, None], "n": [[2] * (n // 2), None], "top": [[max(tfs[2 * i:2 * i + 2]) for i in b], None], "short": [[10] * (n // 2), None], "ids": [None, list(range(n))], "lens": [None, [10] * n], "gone": [None, None]})
    got = P._ranked(rows, [{"x": 1.0}], np.array([1]), 3, 10.0, 2)
    assert got["doc_id"].tolist() == [0, 1, 2] and len(looked) <= 8


def brute_leaders(rows, least):
    heads, out = [], {}
    for name, place, v in sorted(rows, key=lambda r: (r[1], r[0])):
        if not v or not any(v):
            out[name, place] = name
            continue
        u = np.array(v) / np.linalg.norm(v)
        s = [(round(float(u @ h), 9), -i) for i, (_, h) in enumerate(heads)]
        best = max(s, default=(-1, 0))
        out[name, place] = heads[-best[1]][0] if best[0] >= least else name
        if best[0] < least:
            heads.append((name, u))
    return out


@pytest.mark.parametrize("window", [2, 64])
def test_leaders_in_order_of_sight(spark, window):
    r = random.Random(1)
    rows = [(f"{'abcxyz'[i % 6]}{i}", r.randint(0, 90), v) for i, v, _ in vectors(150, 8)]
    rows += [("n1", 5, None), ("n2", 5, []), ("n3", 6, [0.0] * 8)]
    d = spark.createDataFrame(rows, "phrase string, place int, embedding array<double>")
    got = {r["phrase"]: r["leader"] for r in S.leaders(d, 0.8, window=window).collect()}
    assert got == {k[0]: v for k, v in brute_leaders(rows, 0.8).items()}
    assert S.leaders(d.limit(0)).count() == 0 and S.leaders(d.filter("phrase = 'n1'")).first()["leader"] == "n1"


def test_bands_leave_the_stated_chance():
    for n in (10, 1000, 10**7):
        bits, tables = S.bands(n, 0.8)
        assert (1 - (1 - np.arccos(0.8) / np.pi) ** bits) ** tables <= S.MISS


@pytest.mark.parametrize("least", [0.1, 0.34, 0.5, 0.8, 1.0])
def test_similar_sets(spark, least):
    r = random.Random(2)
    rows = [(i, r.sample([f"n{j}" for j in range(14)], r.randint(0, 7)) + ["hot"] * (i % 3 == 0)) for i in range(160)] + [(200 + i, ["same", "hot"]) for i in range(50)] + [(300, None), (301, ["a", "a", None, "b"]), (302, ["b", "a"])]
    d = spark.createDataFrame(rows, "chunk_id long, names array<string>")
    sets = {i: frozenset(x for x in n or [] if x is not None) for i, n in rows}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    want = {(a, b) for a, b in itertools.combinations(sorted(first.values()), 2) if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) and sets[a] & sets[b]}
    assert {(x["a"], x["b"]) for x in G.similar_sets(d, least).collect()} == want
    assert {(x["chunk_id"], x["class_id"]) for x in G.set_classes(d).collect()} == {(i, first[s]) for i, s in sets.items()}
    assert G.similar_sets(d.limit(0), least).count() == 0
    with pytest.raises(ValueError):
        G.similar_sets(d, 0.0)


def louvain(edges, resolution):
    """The sequential method: local moves in node order, then the graph of communities, until none moves."""
    near, home = defaultdict(dict), {}
    for a, b, x in edges:
        near[a][b] = near[a].get(b, 0.0) + x
        near[b][a] = near[b].get(a, 0.0) + x
    home, whole, loops = {n: n for n in near}, sum(sum(x.values()) for x in near.values()), defaultdict(float)
    graph = {a: dict(x) for a, x in near.items()}
    for _ in range(20):
        degree = {a: sum(x.values()) + loops[a] for a, x in graph.items()}
        part, total, moved = {a: a for a in graph}, dict(degree), False
        for _ in range(20):
            still = True
            for a in sorted(graph):
                links = defaultdict(float)
                for b, x in graph[a].items():
                    links[part[b]] += x
                own = part[a]
                total[own] -= degree[a]
                to = max(sorted({own, *links}), key=lambda c: (round(links.get(c, 0.0) - resolution * degree[a] * total[c] / whole, 12), c == own))
                total[to] += degree[a]
                if to != own:
                    part[a], still, moved = to, False, True
            if still:
                break
        if not moved:
            break
        home = {n: part[c] for n, c in home.items()}
        new, fresh = defaultdict(lambda: defaultdict(float)), defaultdict(float)
        for a, x in loops.items():
            fresh[part[a]] += x
        for a, x in graph.items():
            for b, y in x.items():
                if part[a] == part[b]:
                    fresh[part[a]] += y
                else:
                    new[part[a]][part[b]] += y
        graph, loops = {c: dict(new.get(c, {})) for c in set(part.values())}, fresh
    return home


def quality(edges, home, resolution):
    two_m, k, inner = 2 * sum(x for *_, x in edges), defaultdict(float), 0.0
    for a, b, x in edges:
        k[home[a]] += x
        k[home[b]] += x
        inner += 2 * x * (home[a] == home[b])
    return inner / two_m - resolution * sum(x * x for x in k.values()) / two_m ** 2


def test_leiden(spark):
    r = random.Random(8)
    edges = {}
    for a, b in itertools.combinations(range(150), 2):
        if r.random() < (0.4 if a % 10 == b % 10 else 0.015):
            edges[f"n{a}", f"n{b}"] = float(r.randint(1, 3))
    edges |= {(f"x{i}", f"x{i + 1}"): 1.0 for i in range(30)} | {("hub", f"n{i}"): 0.5 for i in range(0, 150, 2)}
    rows = [(a, b, w) for (a, b), w in edges.items()]
    d = spark.createDataFrame([*rows, ("n1", "n1", 5.0), (None, "n1", 1.0)], "u string, v string, weight double")
    got = L.leiden(d)
    found = defaultdict(dict)
    for x in got.collect():
        found[x["level"]][x["node"]] = x["community"]
    q = {x["level"]: x["modularity"] for x in L.modularity(d.filter("u is not null"), got).collect()}
    for level, resolution in L.RESOLUTIONS.items():
        home = found[level]
        assert set(home) == {n for a, b, _ in rows for n in (a, b)}
        mine, theirs = quality(rows, home, resolution), quality(rows, louvain(rows, resolution), resolution)
        assert mine >= 0.99 * theirs and abs(mine - q[level]) < 1e-9, (level, mine, theirs)
        groups = defaultdict(set)
        for n, c in home.items():
            groups[c].add(n)
        for c, g in groups.items():
            assert c == min(g)
            reached, queue = {c}, [c]
            while queue:
                n = queue.pop()
                for a, b, _ in rows:
                    for x, y in ((a, b), (b, a)):
                        if x == n and y in g and y not in reached:
                            reached.add(y)
                            queue.append(y)
            assert reached == g
    small = d.filter("u < 'n12' and v < 'n12'")
    again = [sorted(map(tuple, L.leiden(x, {0: 1.0}, tries=1, moves=3, rounds=2).collect())) for x in (small, small.repartition(3))]
    assert again[0] == again[1] and len(again[0]) > 10
    assert L.leiden(d.limit(0)).count() == 0


def test_page_rank_ways_agree(spark):
    r = random.Random(3)
    rows = [(f"n{r.randint(0, 40)}", f"n{r.randint(0, 60)}", float(r.randint(1, 3))) for _ in range(150)]
    g = spark.createDataFrame(rows, "src string, dst string, weight double")
    seeds = spark.createDataFrame([(1, "n1", 1.0), (1, "n1", 3.0), (1, "n2", 1.0), (2, "n5", 1.0), (3, "nowhere", 1.0), (4, "n7", 0.0)], "query_id long, node string, weight double")
    array = {(x["query_id"], x["node"]): x["score"] for x in G.page_rank(g, seeds).collect()}
    joins = {(x["query_id"], x["node"]): x["score"] for x in G.page_rank(g, seeds, nodes_limit=0).collect()}
    assert set(array) == set(joins) and all(abs(array[k] - joins[k]) < 1e-12 for k in array) and {k[0] for k in array} == {1, 2}
    exact = {(x["query_id"], x["node"]): x["score"] for x in G.page_rank(g, seeds, tolerance=1e-14, steps=200).collect()}
    for epsilon in (1e-3, 1e-10):
        push = G.push_page_rank(g, seeds, epsilon=epsilon).collect()
        off, bound = defaultdict(float), {}
        for x in push:
            off[x["query_id"]] += abs(x["score"] - exact[x["query_id"], x["node"]])
            bound[x["query_id"]] = x["error"]
        have = {(x["query_id"], x["node"]) for x in push}
        for k, s in exact.items():
            off[k[0]] += s if k not in have else 0
        assert set(bound) == {1, 2} and all(off[q] <= bound[q] + 1e-12 for q in bound)
    assert max(bound.values()) < 1e-6 and G.push_page_rank(g.limit(0), seeds).count() == 0
    with pytest.raises(ValueError):
        G.push_page_rank(g, seeds, damping=1.0)
