"""Packing, alignment and resampling against the libraries and brute force, with nulls, empties, repeats, ties and hot features."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestack.llm import alignment, byte_tokens, packing, resampling

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, ids string, start long, weight string, a int"  # names that clash with the operators' own


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    words = [f"w{i}" for i in range(90)] + ["The", "the", "isn't", "Ünï", "漢字", "x,y", "<|endoftext|>", "\n", "\t-", "naïve."]
    out = [(i, " ".join(["the quick", *r.choices(words, k=r.randint(0, 120))])) for i in range(70)]
    return out + [(70, None), (71, ""), (72, " "), (73, "  a \n b  "), (74, out[5][1]), (74, out[5][1]), (None, "no id " * 30), (75, "long " * 6000), (76, "   b 　c"), (77, "▁ is a sign"), (78, "z" * 3000), (79, "a\n\n  b\x00c 🙂")]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in texts], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(P.path(packing.VOCABULARY))


LIB, OF, PLAIN = library(), packing.encoder(P.path(packing.VOCABULARY)), byte_tokens.ByteTokens(P.path(packing.VOCABULARY), special=False, hold=64)
CHARS = st.text(st.sampled_from("ab'stZé1 \n\t\r\x0b\x1c\x85 　,.<|>漢🙂▁\x00"), max_size=24)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(CHARS, st.sampled_from(["<|endoftext|>", "'re", "  ", " \n ", "don't"])), max_size=8).map("".join))
def test_ids_are_the_library_s(text):
    LIB.encode_special_tokens = False
    assert np.frombuffer(OF(text.encode()), OF.width).tolist() == LIB.encode(text, add_special_tokens=False).ids
    LIB.encode_special_tokens = True
    assert np.frombuffer(PLAIN(text.encode()), OF.width).tolist() == LIB.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("window,total", [(8, 0), (8, 1), (8, 8), (8, 39), (2048, 5000)])
def test_cut_is_gapless(window, total):
    r, at, tail, seen = random.Random(total), 0, packing.tail_edges(total, window), []
    while at < total:
        n = min(r.randint(1, 3 * window), total - at)
        pieces = list(packing.cut(at, n, window, tail))
        assert [p[0] for p in pieces] == [0, *np.cumsum([p[1] for p in pieces])[:-1]] and sum(p[1] for p in pieces) == n
        seen += pieces
        at += n
    length = collections.defaultdict(int)
    for _, n, s, o in seen:
        assert o == length[s] and n > 0
        length[s] += n
    assert sorted(length) == list(range(len(length))) and all(n == window or (n < window and n & (n - 1) == 0) for n in length.values())


@pytest.mark.parametrize("window", [64, 2048])
def test_packing(docs, empty, texts, window):
    got = packing.pack(docs, P.path(packing.VOCABULARY), window).collect()
    LIB.encode_special_tokens = False
    want = collections.Counter((i, tuple(LIB.encode(t or "", add_special_tokens=False).ids) + (1,)) for i, t in texts)
    stream, by = {}, collections.defaultdict(int)
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] and r["offset"] + r["length"] <= window
        by[r["sequence_id"]] += r["length"]
        stream[r["sequence_id"], r["offset"]] = (r["doc_id"], r["start"], ids, r["doc_tokens"])
    assert sum(n != window for n in by.values()) <= int(math.log2(window)) and all(n & (n - 1) == 0 for n in by.values())
    found, now = collections.Counter(), []
    for key in sorted(stream):
        doc, start, ids, n = stream[key]
        assert start == len(now)
        now += ids
        if len(now) == n:
            found[doc, tuple(now)] += 1
            now = []
    assert found == want and not now
    assert packing.pack(empty, P.path(packing.VOCABULARY)).count() == 0


def reference_alignment(texts):
    from sentencepiece import SentencePieceProcessor
    sp = SentencePieceProcessor(model_file=P.path(alignment.B))
    LIB.encode_special_tokens = True
    byte, rows, df = byte_tokens.spelling(), [], collections.Counter()
    for i, t in texts:
        row = (i, 0, 0, [], [])
        if t:
            whole = (" " + t).encode()
            e = LIB.encode(" " + t, add_special_tokens=False)
            a, b = e.ids, sp.encode(t)
            of_a = [bytes(byte[c] for c in x) for x in e.tokens]
            of_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(x) else p.replace("▁", " ").encode() for x, p in zip(b, map(sp.id_to_piece, b))]
            if b"".join(of_a) == whole and b"".join(of_b) == whole:
                spans = lambda parts: [(n - len(p), n) for p, n in zip(parts, np.cumsum([len(p) for p in parts]).tolist())]
                sa, sb = spans(of_a), spans(of_b)
                links = [(a[x], b[y]) for x in range(len(a)) for y in range(len(b)) if sa[x][0] < sb[y][1] and sb[y][0] < sa[x][1]] if len(a) < 500 else None
                if links is None:  # the same by places, for long texts
                    at_b = [y for y, (p, q) in enumerate(sb) for _ in range(q - p)]
                    links = [(a[x], b[y]) for x, (p, q) in enumerate(sa) for y in sorted({at_b[z] for z in range(p, q)})]
                ends = sorted({q for _, q in sa} & {q for _, q in sb})
                groups, lo = [], 0
                for hi in ends:
                    groups.append(",".join(str(a[x]) for x, (p, q) in enumerate(sa) if lo <= p and q <= hi) + "|" + ",".join(str(b[y]) for y, (p, q) in enumerate(sb) if lo <= p and q <= hi) if len(a) < 500 else None)
                    lo = hi
                row = (i, len(a), len(b), groups, links)
                df.update(set(links))
        rows.append(row)
    best = collections.defaultdict(int)
    for (a, _), n in df.items():
        best[a] = max(best[a], n)
    out = []
    for i, n_a, n_b, groups, links in rows:
        text = None if None in groups else hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((i, n_a, n_b, len(groups), len(links), sum(df[x] == best[x[0]] for x in links), sum(df[x] for x in links), text))
    return out


@pytest.mark.parametrize("limit", [alignment.LIMIT, 20, 0])
def test_alignment(docs, empty, texts, limit):
    got = [(r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in alignment.align(docs, P.path(alignment.A), P.path(alignment.B), limit=limit).collect()]
    want, key = reference_alignment(texts), lambda r: (r[0] is None, r[0] or 0)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:7] == w[:7] and (w[7] is None or g[7] == w[7]), (g, w)
    if not limit:
        assert alignment.align(empty, P.path(alignment.A), P.path(alignment.B)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(CHARS, max_size=5))
def test_segments_align_as_whole_texts(texts):
    of = alignment.aligner(P.path(alignment.A), P.path(alignment.B))
    got = of([t.encode() for t in texts]).to_dict("records")
    for g, w in zip(got, reference_alignment(list(enumerate(texts))), strict=True):
        assert (g["n_a"], g["n_b"], g["n_groups"], g["n_links"], g["groups_sha256"]) == (*w[1:5], w[7]) and sum(g["times"]) == g["n_links"]


def test_segments_are_learned_anew_when_too_many():
    small, large = alignment.Aligner(P.path(alignment.A), P.path(alignment.B), hold=3), alignment.aligner(P.path(alignment.A), P.path(alignment.B))
    for texts in ([b"one two three", b"two four five six"], [b"one", b"x" * 200 + b" two"], [b"", b"two one"]):
        assert small(texts).astype(str).equals(large(texts).astype(str)) and all(len(s) <= byte_tokens.LONG for s in small.known)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=9), st.lists(st.integers(1, 4), max_size=9))
def test_merge(a, b):
    if sum(a) > sum(b):
        b = [*b, sum(a) - sum(b)]
    elif sum(b) > sum(a):
        a = [*a, sum(b) - sum(a)]
    ends_a, ends_b = np.cumsum(a, dtype=int), np.cumsum(b, dtype=int)
    of_a, of_b, group_a, group_b, _ = alignment.merge(ends_a, ends_b)
    over = [(i, j) for i in range(len(a)) for j in range(len(b)) if ends_a[i] - a[i] < ends_b[j] and ends_b[j] - b[j] < ends_a[i]]
    assert sorted(zip(of_a.tolist(), of_b.tolist())) == over
    both = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
    assert group_a.tolist() == [sum(x < e for x in both) for e in ends_a.tolist()] and group_b.tolist() == [sum(x < e for x in both) for e in ends_b.tolist()]


def reference_resampling(texts, items, buckets=10000, share=5):
    def feats(t):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return len(w), [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    own, s, t = [(i, *feats(x)) for i, x in texts], collections.Counter(), collections.Counter()
    for _, _, f in own:
        s.update(f)
    for _, x in items:
        t.update(feats(x)[1])
    all_s, all_t, out = sum(s.values()), sum(t.values()), []
    for i, n, f in own:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    drawn = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    keep = len(drawn) * share // 100
    return out, [r[0] for r in drawn[:keep]]


@pytest.mark.parametrize("share,buckets", [(5, 10000), (50, 7), (100, 300)])
def test_resampling(spark, docs, empty, texts, monkeypatch, share, buckets):
    items = [(1, "the quick w1 w2"), (2, None), (None, "THE quick isn't"), (3, "")]
    target = spark.createDataFrame(items, "item_id long, text string")
    got = resampling.resample(docs, target, share=share, buckets=buckets).collect()
    want, drawn = reference_resampling(texts, items, buckets, share)
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted([(r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"]) for r in got], key=key) == sorted(want, key=key)
    ranks = sorted((r["rank"], r["doc_id"]) for r in got if r["rank"] is not None)
    assert [r for r, _ in ranks] == list(range(1, len(drawn) + 1)) and [i for _, i in ranks] == drawn
    if buckets == 7:
        monkeypatch.setattr(resampling, "HELD", 4)
        monkeypatch.setattr(resampling, "CHUNK", 200)
        again = resampling.resample(docs.repartition(2), target, share=share, buckets=buckets)
        assert sorted([(r["doc_id"], r["score"], r["rank"]) for r in again.collect()], key=str) == sorted([(r["doc_id"], r["score"], r["rank"]) for r in got], key=str)
        assert resampling.resample(empty, target).count() == 0
        assert resampling.resample(docs, target.limit(0)).filter("rank is not null").count() > 0


def test_large_values_are_packed():
    v = np.array([0, 254, 255, 256, 70000, 1])
    small, large = resampling.packed(v)
    assert resampling.unpacked(small.tobytes() + v[large].astype("<u4").tobytes(), len(v)).tolist() == v.tolist()
