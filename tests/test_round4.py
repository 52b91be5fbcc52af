"""Round 4: what the findings of round 3 named, each on a small input that failed before."""

import itertools
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestack.llm import near_copies as N
from lodestack.llm.simhash import components
from lodestack.operators import graph as G
from lodestack.operators import retrieval as R
from lodestack.operators import turn
from lodestack.plans.registry import ORACLES, QUERIES
from lodestack.sources.vector_index import VectorIndex


def test_page_rank_folds_equal_sinks(spark):
    r = random.Random(5)
    rows = [(f"h{i}", f"h{(i * 3 + j) % 6}", 1.0 + j) for i in range(6) for j in range(2)] + [(f"h{r.randint(0, 5)}", f"s{i}", float(r.randint(1, 2))) for i in range(90)]
    g = spark.createDataFrame(rows, "src string, dst string, weight double")
    seeds = spark.createDataFrame([(1, "h1", 1.0), (1, "s4", 2.0), (2, "s5", 1.0)], "query_id long, node string, weight double")
    few, members = G.folded(G.adjacency(g), seeds)
    assert few.count() < 40 < G.adjacency(g).count() and members.filter("node in ('s4', 's5')").isEmpty()
    want = {(x["query_id"], x["node"]): x["score"] for x in G.page_rank(g, seeds).collect()}
    for limit in (40, 0):
        got = {(x["query_id"], x["node"]): x["score"] for x in G.page_rank(g, seeds, nodes_limit=limit).collect()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_near_phrases_embed_each_name_once(spark, tmp_path):
    class Counting:
        dim = 4

        def embed(self, texts):
            with open(tmp_path / "asked", "a") as f:
                f.write("".join(f"{t}\n" for t in texts))
            return np.ones((len(texts), 4))

    nodes = spark.createDataFrame([("ab",)] * 300 + [("cd",)] * 300, "node string")
    names = spark.createDataFrame([(1, 0, "ab")] * 200, "query_id long, place int, name string")
    assert turn.near_phrases(names, nodes, Counting()).count() == 2
    assert len((tmp_path / "asked").read_text().split()) <= 12


@pytest.mark.parametrize("dense", [0, 10**9])
def test_set_join_both_ways(spark, monkeypatch, dense):
    monkeypatch.setattr(G, "DENSE", dense)
    monkeypatch.setattr(G, "SETS", 16)
    r = random.Random(4)
    sets = {i: set(r.sample(range(12), r.randint(1, 6))) | {100 + i % 40} for i in range(70)}
    first = {}
    for i, x in sets.items():
        first.setdefault(frozenset(x), i)
    d = spark.createDataFrame([(i, [str(y) for y in x]) for i, x in sets.items()], "chunk_id long, names array<string>")
    want = {(a, b, len(sets[a] & sets[b])) for a, b in itertools.combinations(sorted(first.values()), 2) if len(sets[a] & sets[b]) >= 0.4 * len(sets[a] | sets[b])}
    assert {(x["a"], x["b"], x["shared"]) for x in G.similar_sets(d, 0.4).collect()} == want and want


def same_as_sql(spark, tmp_path, name, **tables):
    con = duckdb.connect()
    for t, rows in tables.items():
        rows.to_parquet(tmp_path / f"{t}.parquet")
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    cols = sorted(got.columns)
    want = con.sql(f"select {', '.join(f'\"{c}\"' for c in cols)} from ({ORACLES[name]})").fetchall()
    assert sorted(map(str, (tuple(x) for x in got.select(*[f"`{c}`" for c in cols]).collect()))) == sorted(map(str, want)) and want


@pytest.mark.parametrize("name", ["chapter_fill", "chapter_labels", "doc_part_labels"])
def test_lines_that_begin_like_a_heading(spark, tmp_path, name):
    texts = ["a\n221.7.8.9 Sie kam.\nb", "201 years\n# odd\n3. Foo", None, "2.1"]
    same_as_sql(spark, tmp_path, name, documents=pd.DataFrame({"doc_id": range(1, 5), "text": texts}))


def test_word_edges_as_in_the_sql(spark, tmp_path):
    texts = ["éread ère", "même", "a read é", "tell mé", "nothing"] * 7
    rows = pd.DataFrame({"conv_id": [i // 7 for i in range(35)], "turn": [i % 7 for i in range(35)], "role": "user", "text": texts})
    same_as_sql(spark, tmp_path, "reflective_tiers", conversations=rows)


def test_a_group_of_near_copies_has_about_one_edge_a_set(spark, monkeypatch):
    made = []
    monkeypatch.setattr(N, "components", lambda edges: made.append(edges) or components(edges))
    # each band shares its key among all sets but one, so every band has another least set
    rows = [(s, [-1 - s if s <= b else 0 for b in range(20)]) for s in range(100)] + [(200, [7] * 20), (201, [7] * 20)]
    got = {(x["v"], x["c"]) for x in N.candidates(spark.createDataFrame(rows, "__set long, __keys array<long>")).collect()}
    assert got == {(s, 1) for s in range(1, 100)} | {(200, 200), (201, 200)}
    assert made[0].count() < 130


def test_index_of_vectors_that_cells_do_not_part(spark, tmp_path):
    v = np.random.default_rng(3).standard_normal((3000, 32))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    index = VectorIndex.build(rows, str(tmp_path / "i"))
    asked = rows.filter("vec_id % 60 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {(x["query_id"], x["vec_id"]) for x in R.cosine_neighbours(rows, asked).collect()}
    found = {(x["query_id"], x["vec_id"]) for x in index.search(asked).collect()}
    assert len(found & exact) >= 0.9 * len(exact)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(q, int(i)) for q in range(0, 3000, 60) for i in np.lexsort((np.arange(3000), -np.round(u @ u[q], 5).clip(0, 1)))[:10]}
    assert exact == want


@pytest.mark.parametrize("least", [0.15, 0.4, 0.75, 1.0])
@pytest.mark.parametrize("wide", [512, 7])
def test_set_join_meets_at_the_two_rarest_names(spark, monkeypatch, least, wide):
    """Where few names are in most sets, all pairs of sets are not compared; large groups are parted, names beyond a matrix's width added up."""
    def never(*a):
        raise AssertionError("all pairs compared")

    monkeypatch.setattr(G, "DENSE", 10**9)
    monkeypatch.setattr(G, "SETS", 1)
    monkeypatch.setattr(G, "WIDE", wide, raising=False)
    monkeypatch.setattr(G, "ROW", -(10**9), raising=False)
    monkeypatch.setattr(G, "_dense_sets", never)
    r = random.Random(8)
    sets = {f"k{i}": set(r.sample(range(24), min(24, r.choice([1, 1, 2, 3, 5, 8, 8, 9, 13])))) | ({90} if i % 7 == 0 else set()) for i in range(400)}
    first = {}
    for i in sorted(sets):
        first.setdefault(frozenset(sets[i]), i)
    d = spark.createDataFrame([(i, [str(y) for y in x] + [None]) for i, x in sets.items()] + [("e", []), ("f", None)], "chunk_id string, names array<string>")
    want = sorted((a, b, len(sets[a] & sets[b])) for a, b in itertools.combinations(sorted(first.values()), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least)
    assert sorted((x["a"], x["b"], x["shared"]) for x in G.similar_sets(d, least).collect()) == want and (want or least == 1)
