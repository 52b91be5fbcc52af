"""Near copies of the pipeline against brute force over whole shingle sets."""

import collections
import itertools
import random

import numpy as np

import corpus_pipeline
from lodestack.llm import near_copies

SCHEMA = "doc_id long, text string"


def likeness(a, b):
    x, y = (set(near_copies.shingle_set(t, 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def edited(r, words, edits):
    w = list(words)
    for i in r.sample(range(len(w)), edits):
        w[i] = f"e{r.random()}"
    return " ".join(w)


def kept_of(spark, data):
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    return {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()}


def brute(data):
    part = {i: i for i, _ in data}
    near = [(i, j) for (i, a), (j, b) in itertools.combinations(data, 2) if likeness(a, b) >= 0.8]
    for _ in data:
        for i, j in near:
            part[i] = part[j] = min(part[i], part[j])
    return {i for i in part if part[i] == i}


def test_near_copies_just_above_the_similarity_are_found(spark):
    r = random.Random(4)
    data = []
    for i in range(60):  # pairs of likeness 0.80 to 0.95
        words = [f"v{r.randrange(5000)}" for _ in range(400)]
        data += [(2 * i, " ".join(words)), (2 * i + 1, edited(r, words, r.randint(2, 9)))]
    like = [likeness(data[2 * i][1], data[2 * i + 1][1]) for i in range(60)]
    assert sum(0.8 <= x < 0.9 for x in like) > 20
    assert kept_of(spark, data) == brute(data)


def test_exact_comparison():
    r = random.Random(6)
    sets = [np.unique(np.array([r.randrange(60) for _ in range(r.randint(0, 60))], np.uint64)) for _ in range(40)]
    got = set(zip(*(x.tolist() for x in near_copies.alike(sets, 0.5))))
    s = [set(x.tolist()) for x in sets]
    assert {p for p in got if s[p[0]] | s[p[1]]} == {(a, b) for a, b in itertools.combinations(range(40), 2) if s[a] | s[b] and len(s[a] & s[b]) >= 0.5 * len(s[a] | s[b])}


def test_large_group_with_a_shared_passage_keeps_its_clean_documents(spark):
    r = random.Random(7)
    passage = [f"p{i}" for i in range(160)]
    data = [(i, " ".join(passage + [f"d{i}x{j}" for j in range(40)])) for i in range(300)]  # likeness about 0.66
    data += [(1000 + i, edited(r, data[i][1].split(), 1)) for i in range(20)]
    assert kept_of(spark, data) == set(range(300))


def test_large_group_of_near_copies_is_one(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    data = [(i, edited(r, words, 2)) for i in range(500)]
    assert kept_of(spark, data) == {0}


def test_rows_without_words_are_one(spark):
    data = [(None, "\n"), (5, None), (6, ""), (7, "  "), (8, "one"), (9, "ONE "), (None, "two")]
    df = spark.createDataFrame(data, SCHEMA)
    got = collections.Counter((x["doc_id"], x["text"]) for x in near_copies.keep_one(df, block=2).collect())
    assert got == {(5, None): 1, (8, "one"): 1, (None, "two"): 1}


def test_blocks_give_the_components_of_all_pairs(spark):
    r = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    base = [edited(r, words, 6) for _ in range(8)]
    data = list(enumerate([edited(r, base[i % 8].split(), r.randint(1, 5)) for i in range(90)] + [" ".join(words)]))
    df = spark.createDataFrame(data, SCHEMA)
    for block in (4, 16, 1000):
        assert {x["doc_id"] for x in near_copies.keep_one(df, block=block).collect()} == brute(data)
