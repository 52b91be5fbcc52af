"""Small tests of the training-data operators against brute force, with nulls, empties, repeats and ties."""

import collections
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import decontamination, fingerprints, html_extract, mixing, sharding, simhash, substring_dedup, token_codec, token_count, toxicity

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __x string"


def rows(seed=1, n=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    shared = [" ".join(r.choices(words, k=50)) for _ in range(3)]
    out = [(i, " ".join([" ".join(r.choices(words, k=r.randint(1, 60))), r.choice(shared + [""] * 4), " ".join(r.choices(words, k=r.randint(0, 20)))]), "en", f"s{i % 4}", 1, "x") for i in range(n)]
    return out + [(n, None, None, None, None, None), (n + 1, "", "en", "s0", 0, "x"), (n + 2, out[3][1], "en", "s1", 1, "x"), (n + 2, out[3][1], "en", "s1", 1, "x"), (None, "Ünïcode 漢字 text", "de", None, 2, "x")]


@pytest.fixture(scope="module")
def data():
    return rows()


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_masks_cover_every_pair():
    ms = simhash.masks(4)
    r = random.Random(3)
    for _ in range(300):
        diff = sum(1 << i for i in r.sample(range(64), 4))
        assert any(diff & m == 0 for m in ms)


def test_simhash_components(spark, docs, empty):
    got = simhash.near_duplicates(docs, 4, block=8).collect()
    fp = sorted({r["__fp"] for r in got})
    part = {f: f for f in fp}
    for _ in fp:
        for a, b in itertools.combinations(fp, 2):
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= 4:
                part[a] = part[b] = min(part[a], part[b])
    groups = collections.defaultdict(set)
    for r in got:
        groups[r["__first"]].add(part[r["__fp"]])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(part.values()))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id = 3").count() == 1 and kept.filter(f"doc_id = {62}").count() == 0
    assert simhash.keep_one(empty).count() == 0


def test_fingerprints(docs, empty):
    got = fingerprints.fingerprint(docs).collect()
    by = collections.defaultdict(set)
    for r in got:
        by[r["text"]].add(tuple(r["fingerprint"]))
        assert len(r["fingerprint"]) == fingerprints.M
    assert all(len(v) == 1 for v in by.values()) and by[None] == by[""]
    assert fingerprints.fingerprint(empty).count() == 0


def test_next_rows(spark, docs, empty, data):
    for d, src in ((docs, data), (docs.filter("doc_id is not null"), [r for r in data if r[0] is not None])):
        got = fingerprints.with_next(d.select("doc_id", "text"), "doc_id", "text").collect()
        assert len(got) == len(src)
        texts = collections.defaultdict(set)
        for r in src:
            texts[-1 if r[0] is None else r[0]].add(r[1])
        ids = sorted(texts)
        for r in got:
            i = ids.index(-1 if r["doc_id"] is None else r["doc_id"])
            assert r["__next"] is not None and r["__next"]["text"] in texts[ids[(i + 1) % len(ids)]] | (texts[ids[i]] if r["doc_id"] == 62 else set())
    assert fingerprints.with_next(empty.select("doc_id", "text"), "doc_id", "text").count() == 0


def test_token_counts_match_library(docs, data):
    from sentencepiece import SentencePieceProcessor

    path = P.path(token_count.MODEL)
    sp = SentencePieceProcessor(model_file=path)
    c = token_count.Counter(path)
    for t in ["", " ", "a  b", "<s> </s>", "\n\t\0", "漢字𠮷", "x" * 5000, "▁▁a ▁", *[r[1] or "" for r in data]]:
        assert c(t) == len(sp.encode(t)), t
    assert {r["n_tokens"] for r in token_count.count_tokens(docs.filter("text is null"), path).collect()} == {0}


def test_substring_dedup(docs, data, empty):
    seen = collections.Counter()
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    for r in data:
        w = split(r[1])
        seen.update(tuple(w[i:i + 35]) for i in range(len(w) - 34))
    want = []
    for r in data:
        w = split(r[1])
        hit = {j for i in range(len(w) - 34) if seen[tuple(w[i:i + 35])] > 1 for j in range(i, i + 35)}
        want.append((r[0] is None, r[0], " ".join(x for j, x in enumerate(w) if j not in hit)))
    got = [(r[0] is None, r[0], r["kept_text"]) for r in substring_dedup.remove_repeats(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert substring_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 40, 41, 1000])
def test_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(sharding.permute(F.col("id"), n)).collect()]
    assert sorted(got) == list(range(n))


def test_sharding(docs, empty, data):
    got = sharding.shard(docs, 7).collect()
    counts = collections.Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(got) == len(data)
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    assert sharding.shard(empty).count() == 0


@pytest.mark.parametrize("n", [1, 63, 64, 5000, 200000])
def test_codec_round_trip(n):
    ids = np.random.default_rng(n).zipf(1.3, n) % 50000
    freq = token_codec.normalize(np.bincount(ids))
    symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
    b = token_codec.encode(ids, freq)
    assert (token_codec.decode(b, freq, symbol) == ids).all()
    bad = bytearray(b)
    bad[24] ^= 1
    with pytest.raises((ValueError, IndexError)):
        token_codec.decode(bytes(bad), freq, symbol)


def test_decontamination(spark, docs, empty, data):
    text = " ".join((data[5][1]).split()[:12])
    items = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "nowhere near any of them at all in this corpus")], "item_id long, text string")
    for limit in (0, 1000):
        got = {r["doc_id"]: r for r in decontamination.scan(docs, items, limit=limit).collect()}
        assert got[5]["n_hit"] > 0 and got[5]["items"] == ["1"] and got[60]["n_words"] == 0
    kept = decontamination.decontaminate(docs, items)
    assert kept.filter("doc_id = 5").count() == 0 and kept.columns == docs.columns
    assert decontamination.decontaminate(empty, items).count() == 0
    assert decontamination.decontaminate(docs, items.limit(0)).count() == len(data)


def test_mixing(docs, empty, data):
    got = mixing.mix(mixing.with_size(docs), block=10).collect()
    assert len(got) == len(data) and all(0 <= r["times"] <= 2 for r in got)
    for s in {r["source"] for r in got}:
        part = [r for r in got if r["source"] == s]
        assert abs(sum(r["times"] * r["__size"] for r in part) - part[0]["target"]) <= max(r["__size"] for r in part) * 2 + 1
    assert mixing.mix(mixing.with_size(empty)).count() == 0


def test_html(spark):
    page = '<html><head><title>t</title></head><body><nav><a>menu</a></nav><div class="ad">buy</div><article><h1>A &amp;  B</h1><p>one <b>two</b></p><div class="comments">no</div></article><footer>f</footer></body></html>'
    df = spark.createDataFrame([(1, "http://h/1", page), (2, "http://h/2", None), (3, None, ""), (4, "http://h/3", "plain  text")], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert got == {1: "A & B\none two", 2: "", 3: "", 4: "plain text"}


def test_toxicity(spark, docs, empty):
    r = random.Random(5)
    texts = [(i, " ".join(r.choices([f"w{j}" for j in range(50)], k=30) + (["vile"] * 2 if i % 4 == 0 else [])), int(i % 4 == 0)) for i in range(400)]
    df = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    w = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    s = {r["doc_id"]: r["score"] for r in toxicity.score(df, w).collect()}
    assert sum((s[i] >= 0.3) == bool(y) for i, _, y in texts) >= 390
    assert toxicity.score(empty, w).count() == 0 and toxicity.train(empty, df.limit(0).select("doc_id", "toxic")) is None
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, w).collect())
