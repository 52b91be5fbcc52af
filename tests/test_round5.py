"""Round 5: what the findings of round 3's second reading named, each on a small input that failed before."""

import random
from pathlib import Path

import numpy as np
import pandas as pd

import corpus_pipeline
from lodestack.llm import near_copies as N
from lodestack.llm.simhash import components, links
from lodestack.operators import leiden as L
from lodestack.operators import retrieval as R
from lodestack.operators import similar as S
from lodestack.operators import taxonomy as X
from lodestack.sources.tables import shared


def stored(spark):
    return sum(p.stat().st_size for p in Path(shared(spark).removeprefix("file:")).rglob("*.parquet"))


def test_leaders_write_no_more_than_a_few_rows_a_phrase(spark):
    g = np.random.default_rng(1)
    v = g.standard_normal((1500, 24))
    v[750:1000] = v[:250] + 0.3 * g.standard_normal((250, 24))  # followers, some of several leaders
    order = random.Random(2).sample(range(1500), 1500)
    rows = spark.createDataFrame([(f"p{i}", order[i], x.tolist()) for i, x in enumerate(v)], "phrase string, place int, embedding array<double>")
    before = stored(spark)
    got = {r["phrase"]: (r["leader"], r["score"]) for r in S.leaders(rows, 0.7, window=400).collect()}
    assert stored(spark) - before < 3 * v.nbytes
    u, heads, want = v / np.linalg.norm(v, axis=1, keepdims=True), [], {}
    for i in np.argsort(order):
        s = np.round(u[heads] @ u[i], 9)
        if len(heads) and s.max() >= 0.7:
            want[f"p{i}"] = f"p{heads[int(s.argmax())]}", float(s.max())
        else:
            heads.append(i)
            want[f"p{i}"] = f"p{i}", 1.0
    assert {k: x[0] for k, x in got.items()} == {k: x[0] for k, x in want.items()} and len(heads) < 1300
    assert all(abs(got[k][1] - want[k][1]) < 1e-8 for k in want)


def test_near_copies_have_the_links_of_their_fingerprints(spark, monkeypatch):
    r = random.Random(3)
    words = [[f"v{r.randrange(9000)}" for _ in range(600)] for _ in range(30)]
    texts = [" ".join(w) for w in words] + [" ".join([*w[:300], "x", *w[300:]]) for w in words]
    prints = [N.fingerprint(N.shingle_hashes(t, 5)) for t in texts]
    near = {(i, j) for i in range(60) for j in range(i) if ((prints[i] ^ prints[j]) & ((1 << 64) - 1)).bit_count() <= 4}
    frame = spark.createDataFrame(list(enumerate(prints)), "__set long, __fp long")
    parts = {x["v"]: x["c"] for x in components(N.fingerprint_links(frame)).collect()}
    assert all(parts[i] == parts[j] for i, j in near) and set(parts) == {x for p in near for x in p} and len(near) >= 25
    empty = spark.createDataFrame([(i, []) for i in range(60)], "__set long, __keys array<long>")
    assert N.candidates(empty, N.fingerprint_links(frame)).count() == len(parts)
    made = []
    monkeypatch.setattr(N, "links", lambda fps, radius: made.append(fps.count()) or links(fps, radius))
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "")
    assert {x["doc_id"] for x in kept.collect()} == set(range(30)) and made == [len(set(prints))]


def test_caps_count_documents_of_the_same_nodes_together(spark):
    filed = spark.createDataFrame([(f"d{i}", n) for i in range(40) for n in (["a", "b"] if i < 10 else ["b"] if i < 15 else ["c"])] + [(None, "a")], "doc_id string, node_id string")
    leaves = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.8), (1, "c", 0.7), (2, "c", 0.9), (2, "a", 0.1), (3, "none", 0.5), (3, "a", 0.4)], "query_id long, node_id string, score double")
    got = X.capped_leaves(leaves, filed, 0.4)
    assert {(x["query_id"], x["node_id"]) for x in got.collect()} == {(1, "a"), (1, "b"), (2, "c"), (3, "none"), (3, "a")}
    assert "doc_id" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_neighbours_below_the_nodes_of_a_query(spark):
    g = np.random.default_rng(5)
    v = {i: [float(x) for x in g.standard_normal(8)] for i in range(60)} | {60: [0.0] * 8, 61: None}
    nodes = {i: ["a"] if i % 3 == 0 else ["b"] if i % 3 == 1 else ["a", "c"] for i in v}
    scope = {1: {"a", "c"}, 2: {"b"}, 3: {"none"}}
    asked = {q: [float(x) for x in g.standard_normal(8)] for q in (1, 2, 3, 4)}
    got = R.neighbours_below(spark.createDataFrame([(i, nodes[i], v[i]) for i in v], "doc_id long, nodes array<string>, embedding array<double>"), spark.createDataFrame(list(asked.items()), "query_id long, embedding array<double>"),
                             spark.createDataFrame([(q, n) for q, x in scope.items() for n in x], "query_id long, node_id string"), 30)
    cos = lambda a, b: 0.0 if b is None or not any(b) else float(np.clip(round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 5), 0, 1))
    want = {q: sorted((-cos(asked[q], v[i]), i) for i in v if scope[q] & set(nodes[i]))[:30] for q in scope}
    assert sorted((x["query_id"], x["rank"], x["doc_id"], x["score"]) for x in got.collect()) == sorted((q, r + 1, i, -s) for q, x in want.items() for r, (s, i) in enumerate(x))


def test_portions_bound_what_is_made_of_a_batch():
    texts = ["x" * n for n in (5, 5, 5, 30, 0, 1)] + [None] * 1200
    parts = [p["text"].tolist() for p in R.portions(pd.DataFrame({"text": texts}), 10)]
    assert [x for p in parts for x in p] == texts and max(map(len, parts)) <= 512
    assert [len(p) for p in parts[:3]] == [2, 1, 1] and list(R.portions(pd.DataFrame({"text": []}, dtype=object))) == []


def test_batches_are_tokenized_in_portions(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(R, "portions", lambda pdf, size=0, f=R.portions: (seen.append(len(p)) or p for p in f(pdf, 40)))

    class Docs:  # the function given to mapInPandas, run here on one batch
        schema = spark.createDataFrame([(1,)], "doc_id long").schema

        def select(self, *_):
            return self

        def mapInPandas(self, f, _):
            self.made = list(f([pd.DataFrame({"text": ["ab cd ab " * 2] * 50})]))
            return spark.createDataFrame(pd.concat(self.made).astype({"df": "int64", "tf": "int64"}), "term string, df long, tf long")

    docs = Docs()
    got = {x["term"]: (x["df"], x["tf"]) for x in R.document_frequencies(docs).collect()}
    assert got == {None: (50, 300), "ab": (50, 200), "cd": (50, 100)} and len(docs.made) == 25 == len(seen)


def test_leaves_of_a_graph_are_folded_before_the_supersteps(spark, monkeypatch):
    made = []
    monkeypatch.setattr(L, "_step", lambda edges, *a, f=L._step: made.append(edges.count()) or f(edges, *a))
    hubs = [f"h{i}" for i in range(6)]
    rows = [(a, b, 2.0) for i, a in enumerate(hubs) for j, b in enumerate(hubs) if i < j and i % 2 == j % 2] + [("h0", "h1", 1.0), ("y", "z", 1.0)]
    rows += [(h, f"{'ab'[i % 2]}{h}{i}", 1.0) for h in hubs for i in range(30)]
    got = {x["node"]: x["community"] for x in L.leiden(spark.createDataFrame(rows, "u string, v string, weight double"), {0: 1.0}, tries=1, moves=3, rounds=2, last=2).collect()}
    assert set(got) == {x for a, b, _ in rows for x in (a, b)} and max(made) <= 14
    assert all(got[v] == got[u] for u, v, w in rows if v[0] in "ab") and got["z"] == "y" == got["y"]
    assert all(c == min(n for n in got if got[n] == c) for c in got.values())
    star = spark.createDataFrame([("h", f"s{i}", 1.0) for i in range(9)], "u string, v string, weight double")
    assert {x["node"] for x in L.leiden(star, {0: 2.0}, tries=1, moves=2, rounds=1, last=1).collect()} == {"h", *(f"s{i}" for i in range(9))}
