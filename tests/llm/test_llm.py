"""The training-data operators against brute force, exact round trips and edge cases."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from quadrille.llm import ann, chat, mixing, neardup, queries, spm, substring, tokens, topk, toxicity, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPM, BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def words(n, seed, size=400):
    rng = np.random.default_rng(seed)
    return [f"w{i}" for i in rng.integers(0, size, n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, white, short, long, repeated and clashing rows."""
    long = " ".join(words(30_000, 1, 5000))
    rows = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \t\n", None, "b", 3), (4, "one two", "en", "a", 7), (5, long, "en", "a", 9), (5, long, "en", "a", 9), (None, "no id here", "de", "b", None), (6, "日本語 é 😀\u00a0x  y<|endoftext|> \n", "en", "c", 4)]
    return spark.createDataFrame([(*r, 0.5, 1, 2) for r in rows], DOCS + ", score double, size long, ids long")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# ---- 1 and 4: searches


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_top_k(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(300, 8)).astype(np.float32)
    m[10:20] = m[10]
    rows = [(i, r.tolist(), 0) for i, r in enumerate(m)]
    got = topk.exact_top_k(vectors(spark, rows), F.col("id") % 50 == 0, 5).toPandas()
    v = np.floor(m.astype(float) * 256).astype(int)
    for q in range(0, 300, 50):
        order = sorted((i for i in range(300) if i != q), key=lambda i: (-int(v[q] @ v[i]), i))[:5]
        x = got[got.query_id == q].sort_values("rank")
        assert x.vec_id.tolist() == order and x.score.tolist() == [int(v[q] @ v[i]) for i in order]


def test_top_k_edges(spark):
    rows = [(0, [1.0, 2.0], 0), (1, None, 0), (2, [1.0, None], 0), (3, [float("nan"), 1.0], 0), (4, [float("inf"), 1.0], 0), (None, [1.0, 1.0], 0), (5, [1.0], 0), (6, [3e38, 1.0], 0), (50, [0.0, 0.0], 0), (50, [0.0, 0.0], 0)]
    got = topk.exact_top_k(vectors(spark, rows), F.col("id") % 50 == 0, 5).toPandas()
    assert got[got.query_id == 0].vec_id.tolist() == [6, 5, 50, 50] and set(got.query_id) == {0, 50}
    assert got[got.query_id == 50].vec_id.tolist() == [0, 5, 6]
    assert topk.exact_top_k(vectors(spark, []), F.col("id") % 50 == 0, 5).count() == 0


def test_tiles_and_tree_merge(spark, monkeypatch):
    from quadrille.llm import blocks

    monkeypatch.setattr(blocks, "TILE", 3)
    monkeypatch.setattr(blocks, "SHARD", 5)
    rng = np.random.default_rng(1)
    m = rng.integers(-3, 4, (150, 4)).astype(float)
    got = topk.exact_top_k(vectors(spark, [(i, r.tolist(), 0) for i, r in enumerate(m)]), F.col("id") % 10 == 0, 4, scale=1).toPandas()
    for q in range(0, 150, 10):
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == sorted((i for i in range(150) if i != q), key=lambda i: (-m[q] @ m[i], i))[:4]


def test_nearest_recall(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = queries.op4_nearest_neighbours(spark, sf_dir).toPandas()
    p = e.toPandas().sort_values("vec_id")
    m, ids = np.stack(p.embedding).astype(float), p.vec_id.to_numpy()
    recall = []
    for q, x in got.groupby("query_id"):
        s = m @ m[ids == q][0]
        s[ids == q] = -np.inf
        recall.append(len(set(ids[np.argsort(-s)[:20]]) & set(x.vec_id)) / 20)
        assert np.allclose(x.score, [s[ids == v][0] for v in x.vec_id], atol=1e-12) and x.score.is_monotonic_decreasing
    assert np.mean(recall) >= 0.9 and len(recall) == (ids % 20 == 0).sum()


def test_nearest_edges(spark):
    rows = [(0, [0.0, 0.0], 0), (20, [1.0, 0.0], 0), (21, [5.0, 0.0], 0), (22, [5.0, 0.0], 0), (23, None, 0), (24, [float("nan"), 0.0], 0), (25, [-1.0, 9.0], 0)]
    got = ann.nearest(vectors(spark, rows), F.col("id") % 20 == 0, 20).toPandas()
    assert got.query_id.tolist() == [20] * 3 and got.vec_id.tolist() == [21, 22, 25] and got.score.tolist() == [5, 5, -1] and got["rank"].tolist() == [1, 2, 3]
    assert ann.nearest(vectors(spark, []), F.col("id") % 20 == 0, 20).count() == 0


# ---- 2: URLs


def test_url_rules(spark):
    rows = [("http://Foo.NET/x", "foo.net", "/x", "net/", "block"), ("https://a.example.net/en/1?q", "a.example.net", "/en/1", "example.net/en/", "allow"), ("http://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
            ("http://x.org/fr/a#b", "x.org", "/fr/a", "org/fr/", "allow"), ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"), ("http://foo.net", "foo.net", "", None, "allow"), ("no url", "", "", None, "allow"), (None, "", "", None, "allow"), ("a://b?://c.net/x", "b", "", None, "allow"), ("", "", "", None, "allow")]
    pages = spark.createDataFrame([(i, r[0], "<p>") for i, r in enumerate(rows)] + [(0, rows[0][0], "")], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = urls.filtered(spark, pages, labels).toPandas().sort_values("page_id")
    assert len(got) == len(rows) + 1
    for i, r in enumerate(rows):
        x = got[got.page_id == i].iloc[0]
        assert (x.host, x.path, x.rule if isinstance(x.rule, str) else None, x.verdict) == r[1:]


def test_mined_rules(spark):
    """A token pair that goes with bad pages blocks; each of its tokens alone doesn't."""
    hosts = [("bad.shop.com", 0, 30), ("bad.news.com", 1, 60), ("good.shop.com", 1, 60), ("plain.com", 1, 60)]
    rows = [(h, q) for h, q, n in hosts for _ in range(n)]
    pages = spark.createDataFrame([(i, f"http://{h}/p{i}/x") for i, (h, _) in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(i, q, 0) for i, (_, q) in enumerate(rows) if i % 5], "doc_id long, quality int, toxic int")
    mined = urls.mined(pages, labels).toPandas()
    sets = [frozenset(a) for a in mined.antecedent]
    assert frozenset(["h:bad", "h:shop"]) in sets and all(len(s) >= 2 for s in sets)
    got = urls.filtered(spark, pages, labels).toPandas()
    by_host = got.groupby("host").verdict.unique()
    assert {h: v.tolist() for h, v in by_host.items()} == {h: ["block" if q == 0 else "allow"] for h, q, _ in hosts}
    # Brute force over the mined rules.
    for r in got.itertuples():
        have = {f"h:{x}" for x in r.host.split(".")} | {"p:" + re.sub("[0-9]+", "0", x) for x in r.path.split("/") if x}
        assert (r.verdict == "block") == any(s <= have for s in sets)


def test_mined_rules_of_long_urls(spark):
    """Tokens late in the alphabet count however many a URL has, also where very many go together."""
    label = lambda tag, n: ".".join(f"{tag}{k:02d}" for k in range(n))
    urls_of = [(f"http://{label(f'u{i}x', 26)}/{'bad' if i % 2 else 'good'}/z", i % 2) for i in range(80)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls_of)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - b, 0) for i, (_, b) in enumerate(urls_of)], "doc_id long, quality int, toxic int")
    assert [tuple(r["antecedent"]) for r in urls.mined(pages, labels).collect()] == [("p:bad",)]
    assert {(r["page_id"] % 2, r["verdict"]) for r in urls.filtered(spark, pages, labels).collect()} == {(1, "block"), (0, "allow")}
    # 30 labels of one host go together on bad pages and, but for the last, on good ones; nothing longer than needed is mined.
    rows = [(f"http://{label('c', 30)}/x", 0)] * 30 + [(f"http://{label('c', 29)}/x", 1)] * 15 + [("http://c29/y", 1)] * 15
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(i, q, 0) for i, (_, q) in enumerate(rows)], "doc_id long, quality int, toxic int")
    got = {tuple(r["antecedent"]): r["confidence"] for r in urls.mined(pages, labels).collect()}
    every = [f"h:c{k:02d}" for k in range(29)] + ["p:x"]
    assert got == {(t,): 30 / 45 for t in [*every, "h:c29"]} | {tuple(sorted((t, "h:c29"))): 1.0 for t in every}


def test_mined_rules_against_all_itemsets(spark):
    rng = np.random.default_rng(8)
    baskets = [([t for t in "abcdef" if rng.random() < 0.5], bool(rng.random() < 0.4)) for _ in range(300)]
    baskets = [(x, bad or {"a", "c"} <= set(x) and rng.random() < 0.7) for x, bad in baskets]
    pages = spark.createDataFrame([(i, "http:///" + "/".join(x)) for i, (x, _) in enumerate(baskets)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if bad else 1, 0) for i, (_, bad) in enumerate(baskets)], "doc_id long, quality int, toxic int")
    rules = {}
    for k in range(1, 7):
        for s in itertools.combinations("abcdef", k):
            has = [bad for x, bad in baskets if set(s) <= set(x)]
            if sum(has) >= 10 and sum(has) / len(has) >= 0.6:
                rules[s] = sum(has) / len(has)
    want = {s: c for s, c in rules.items() if not any(set(r) < set(s) and d + urls.GAIN >= c for r, d in rules.items())}
    got = {tuple(t[2:] for t in r["antecedent"]): r["confidence"] for r in urls.mined(pages, labels).collect()}
    assert got == want and max(map(len, want)) > 1


def test_rules_of_interchangeable_tokens(spark):
    """Three groups of 30 tokens that go together, 30^3 choices: one rule of three items; URLs with a part of a group count choices."""
    part = lambda t, n: [f"{t}{chr(97 + k // 6)}{chr(97 + k % 6)}" for k in range(n)]
    rows = []
    for i in range(160):
        have = [bool(i >> k & 1) for k in range(3)]
        rows.append(("http:///" + "/".join(x for t, h in zip("xyz", have) if h for x in part(t, 30)), all(have)))
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)] + [(900, "http:///" + "/".join(part("x", 2) + part("y", 3) + part("z", 4))), (901, "http:///xaa/yaa")], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if bad else 1, 0) for i, (_, bad) in enumerate(rows)], "doc_id long, quality int, toxic int")
    found = urls.rules_of(pages, labels).collect()
    assert [sorted(len(i["members"]) for i in r["items"]) for r in found] == [[30, 30, 30]]
    got = {r["page_id"]: (r["verdict"], r["n_fired"]) for r in urls.filtered(spark, pages, labels).collect()}
    want = {i: ("block", 27_000) if bad else ("allow", 0) for i, (_, bad) in enumerate(rows)}
    assert got == want | {900: ("block", 24), 901: ("allow", 0)}


def test_rules_of_many_frequent_tokens(spark):
    """Nine tokens, each in seven of ten URLs, whatever the label: all their sets are frequent, and counted right."""
    rng = np.random.default_rng(5)
    rows = [([t for t in "abcdefghi" if rng.random() < 0.7], bool(rng.random() < 0.5)) for _ in range(400)]
    pages = spark.createDataFrame([(i, "http:///" + "/".join(x)) for i, (x, _) in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if bad else 1, 0) for i, (_, bad) in enumerate(rows)], "doc_id long, quality int, toxic int")
    sure = {}
    for k in range(1, 10):
        for s in itertools.combinations("abcdefghi", k):
            has = [bad for x, bad in rows if set(s) <= set(x)]
            if sum(has) >= 10 and sum(has) / len(has) >= 0.55:
                sure[frozenset(s)] = sum(has) / len(has)
    want = {s: c for s, c in sure.items() if not any(r < s and d + urls.GAIN >= c for r, d in sure.items())}
    assert {frozenset(t[2:] for t in r["antecedent"]): r["confidence"] for r in urls.mined(pages, labels, confidence=0.55).collect()} == want and want


# ---- 3: SentencePiece


def test_spm_matches_library(spark, odd):
    sp = sentencepiece.SentencePieceProcessor(model_file=SPM)
    got = spm.encoded(odd, SPM, keep=("lang",)).collect()
    texts = [r["text"] or "" for r in odd.collect()]
    assert sorted((r["ids"], r["decoded"]) for r in got) == sorted((sp.encode(t, add_eos=True), sp.decode(sp.encode(t))) for t in texts)
    assert got[0].asDict().keys() == {"doc_id", "lang", "ids", "begins", "ends", "decoded"}


def test_spm_spans():
    with open(SPM, "rb") as f:
        codec = spm.Codec(f.read())
    for text in ("a  b é", "日本語 😀 x", " lead", "tail ", "\u2581 a", ""):
        ids, _ = codec.ids(pa.array([text], pa.large_string()))
        b, e = codec.spans(text.encode(), ids)
        pieces = codec.sp.encode(text, return_type="proto").pieces
        assert [(p.begin, p.end) for p in pieces] == list(zip(b.tolist(), e.tolist()))[:-1]
        assert b"".join(text.encode()[x:y] for x, y in zip(b, e)) == text.encode()


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
def test_char_map(rule):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    own = spm.Normalizer(library.serialized_normalizer_spec())
    rng = np.random.default_rng(5)
    letters = list("aAＡ ｶﾞﬁ①㍿ \té́\u200b\u3000x.😀\n")
    for _ in range(500):
        text = "".join(rng.choice(letters, rng.integers(0, 12)))
        want, offsets = library.normalize(text, with_offsets=True)
        got, source = own(text.encode())
        place = {len(text[:k].encode()): k for k in range(len(text) + 1)}
        starts = [len(want[:k].encode()) for k in range(len(want) + 1)]
        assert got.decode() == want and [place[int(source[k])] for k in starts] == list(offsets)


# ---- 5: near-duplicates


def bag(text):
    w = WORD.findall(text or "")
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def weighted(a, b):
    i = sum((a & b).values())
    return i / ((sum(a.values()) + sum(b.values()) - i) or 1)


def edited(w, share, seed):
    rng, w = np.random.default_rng(seed), list(w)
    for i in rng.choice(len(w), max(1, int(share * len(w))), replace=False):
        w[i] = f"z{rng.integers(1 << 40)}"
    return w


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    m = 4096
    for shared, extra, top in ((300, 100, 1), (200, 150, 6), (50, 20, 40)):
        keys = rng.integers(0, 1 << 63, shared + 2 * extra).astype(np.uint64)
        a = {k: int(c) for k, c in zip(keys[: shared + extra], rng.integers(1, top + 1, shared + extra))}
        b = {k: int(c) for k, c in zip(np.r_[keys[:shared], keys[shared + extra :]], rng.integers(1, top + 1, shared + extra))}
        true = sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
        e = np.concatenate([np.array(list(x), np.uint64) for x in (a, b)])
        c = np.concatenate([np.array(list(x.values())) for x in (a, b)])
        s = neardup.signatures(e, c, np.array([0, len(a), len(a) + len(b)]), m)
        assert abs((s[0] == s[1]).mean() - true) < 5 * math.sqrt(true * (1 - true) / m) + 1e-9


def test_classes_against_brute_force(spark):
    texts = {}
    for g in range(6):
        base = words(150, g, 3000)
        for k in range(12):
            texts[len(texts)] = " ".join(edited(base, (0.002, 0.01, 0.03, 0.06)[k % 4], 100 * g + k))
    for g in range(4):
        texts[len(texts)] = texts[g * 12]
    shared = words(60, 99, 3000)
    for k in range(40):
        texts[len(texts)] = " ".join(shared + words(70, 500 + k, 3000))
    bags = {d: bag(t) for d, t in texts.items()}
    label = {d: d for d in texts}

    def find(d):
        while label[d] != d:
            d = label[d]
        return d

    for a, b in itertools.combinations(texts, 2):
        if weighted(bags[a], bags[b]) >= 0.8:
            x, y = sorted((find(a), find(b)))
            label[y] = x
    got = neardup.near_duplicates(spark.createDataFrame([(d, t, "en", "s", 1) for d, t in texts.items()], DOCS)).toPandas()
    assert dict(zip(got.doc_id, got.class_id)) == {d: find(d) for d in texts}


def test_overlaps():
    rng = np.random.default_rng(1)
    bags = []
    for _ in range(30):
        x = np.unique(rng.integers(0, 60, 25)).astype(np.uint64)
        bags.append((x, rng.integers(1, 5, len(x)) if rng.random() < 0.7 else None))
    shared, weight = neardup.overlaps(bags, 7)
    count = [collections.Counter(dict(zip(x.tolist(), (c if c is not None else np.ones(len(x), int)).tolist()))) for x, c in bags]
    assert (shared == [[sum((a & b).values()) for b in count] for a in count]).all() and weight.tolist() == [sum(a.values()) for a in count]
    assert neardup.overlaps([])[0].shape == (0, 0)


@pytest.mark.parametrize("few, block, counters, whole", [(1, 4, 1 << 18, 16), (1, 512, 7, 0), (64, 512, 1, 16)])
def test_large_buckets_lose_no_link(spark, monkeypatch, few, block, counters, whole):
    """A chain of texts, each like the next but not like the first, in common buckets: pair by pair, by blocks, in any order of shingles."""
    for name, value in (("FEW", few), ("BLOCK", block), ("WHOLE", whole), ("COUNTERS", counters), ("BANDS", 6), ("ROWS", 2)):
        monkeypatch.setattr(neardup, name, value)
    base, texts = words(300, 7, 5000), {}
    for k in range(30):
        base = base[4:] + [f"n{k}_{i}" for i in range(4)]
        texts[k] = " ".join(base)
    got = neardup.near_duplicates(spark.createDataFrame([(d, t, "en", "s", 1) for d, t in texts.items()], DOCS)).toPandas()
    assert set(got.class_id) == {0}


@pytest.mark.parametrize("few, block, whole", [(2, 2, 16), (2, 2, 0), (2, 512, 0), (64, 512, 16)])
def test_pairs_that_share_one_bucket_only(spark, monkeypatch, few, block, whole):
    """All texts share one bucket and half of their words; only similar ones, far from the bucket's first, are linked."""
    for name, value in (("FEW", few), ("BLOCK", block), ("WHOLE", whole)):
        monkeypatch.setattr(neardup, name, value)
    common = words(60, 1, 5000)
    texts = {i: " ".join(common + words(60, 50 + i, 5000)) for i in range(400)}
    for i in range(0, 400, 7):
        texts[i + 1] = " ".join(edited(texts[i].split(" "), 0.01, i)) if i else texts[1]
        texts[i + 2] = texts[i + 1] + " " + " ".join(words(12, i)) * (i % 2)
    members = spark.createDataFrame([(i, [7, 1000 + i]) for i in texts], "doc_id long, bands array<long>")
    got = {r["doc_id"]: r["class_id"] for r in neardup.linked(members, spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    bags, label = {d: bag(t) for d, t in texts.items()}, {d: d for d in texts}

    def find(d):
        while label[d] != d:
            d = label[d]
        return d

    for a, b in itertools.combinations(texts, 2):
        if weighted(bags[a], bags[b]) >= 0.8:
            x, y = sorted((find(a), find(b)))
            label[y] = x
    assert {d: got.get(d, d) for d in texts} == {d: find(d) for d in texts} and len(got) > 50


def test_repeated_shingles_in_prefix(spark):
    """Bags with counts meet by their rarest shingles: brute force over all pairs."""
    rng = np.random.default_rng(3)
    bags = {}
    for i in range(60):
        x = np.unique(rng.integers(0, 30, 14)).astype(np.uint64)
        bags[i] = (x, rng.integers(1, 6, len(x)))
        if i % 3 == 1:
            x, c = bags[i - 1]
            bags[i] = (x, np.maximum(1, c - (rng.random(len(c)) < 0.15)))
    blob = lambda x, c: x.tobytes() + b"\1" + c.astype("<u4").tobytes()
    rows = neardup._rarest(spark.createDataFrame([(i, i, blob(*b)) for i, b in bags.items()], "doc_id long, class_id long, bag binary")).collect()
    by = collections.defaultdict(set)
    for r in rows:
        by[r["key"]].add(r["b"])
    meet = {p for g in by.values() for p in itertools.combinations(sorted(g), 2)}
    alike = {(a, b) for a, b in itertools.combinations(bags, 2) if neardup.similarity(blob(*bags[a]), blob(*bags[b])) >= 0.8}
    assert alike <= meet and len(alike) > 5


def test_deduplicated_keeps_texts_of_one_id(spark):
    long = words(100, 1)
    rows = [(1, " ".join(long), "a"), (1, "another text of the same id", "b"), (1, "another text of the same id", "b"), (2, " ".join([*long, "more"]), "c"), (3, "another text of the same id", "d"), (4, None, "e"), (4, None, "e")]
    got = [(r["doc_id"], r["text"]) for r in neardup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, row string")).collect()]
    assert sorted("-" if t is None else t[:7] for _, t in got) == sorted(["-", "another", " ".join(long)[:7]])


def test_near_duplicates_edges(spark, odd, none):
    got = neardup.near_duplicates(odd).toPandas().set_index("doc_id")
    assert got.class_id.to_dict() == {d: d for d in range(1, 7)}
    left = neardup.deduplicated(odd)
    assert left.columns == odd.columns and left.filter("doc_id = 5").count() == 1 and left.filter("doc_id is null").count() == 1
    assert neardup.near_duplicates(none).count() == 0 and neardup.deduplicated(none).count() == 0


# ---- 6: mixing


def target_of(size, weights=(5, 2, 1), most=3):
    names = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in size)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total = sum(size.values())
    t = {s: total * w[s] / sum(w.values()) for s in names}
    open_ = set(names)
    while over := [s for s in open_ if t[s] > most * size[s] + 1e-9]:
        extra = sum(t[s] - most * size[s] for s in over)
        for s in over:
            t[s] = most * size[s]
            open_.discard(s)
        share = sum(w[s] for s in open_)
        for s in open_:
            t[s] += extra * w[s] / share
    return t


def brute_mix(rows):
    """Efraimidis and Spirakis document by document: (doc_id, source) -> words taken of each of its rows, in descending order."""
    size = collections.Counter()
    for d, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    target, out = target_of(size), collections.defaultdict(list)

    def key(d, t):
        solid = len(re.sub(r"[\x20\x09-\x0D]+", "", t or ""))
        marks = len(regex.sub(r"[\x20\x09-\x0D\p{L}]+", "", t or ""))
        u = (int(hashlib.md5(f"mix-1:{'' if d is None else d}:{t or ''}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        return -math.log(u) / max(0.05, (solid - marks) / solid if solid else 0.05)

    left = {s: math.floor(target[s] - (target[s] // n if n else 0) * n) for s, n in size.items()}
    for d, t, s in sorted(rows, key=lambda r: (key(r[0], r[1]), r[0] is not None, r[0] or 0)):
        n = len(WORD.findall(t or ""))
        part = min(n, left[s])
        left[s] -= part
        out[d, s].append(n * int(target[s] // size[s] if size[s] else 0) + part)
    return {k: sorted(v, reverse=True) for k, v in out.items()}, target


def mix_rows(case):
    rng = np.random.default_rng(3)
    rows = []
    if case == "many":
        for s, n in (("b", 400), ("a", 12), (None, 30), ("c", 90), ("ä", 5), ("d", 60)):
            rows += [(len(rows) + k, " ".join(words(int(rng.integers(1, 80)), 1000 + len(rows) + k)) + " 1.2 --" * (k % 3), s) for k in range(n)]
    elif case == "large":  # few large documents among small ones
        rows = [(i, "wort " * int(n), "b") for i, n in enumerate([5000, 7000, *rng.integers(5, 30, 200)])] + [(900 + i, "wort " * 450, "a") for i in range(4)] + [(990, None, "c"), (991, "", "d")]
    else:  # one row a hundred times, without an id too
        rows = [(7, "eins zwei drei vier fünf", "b")] * 100 + [(i, "wort " * 9, "b") for i in range(20, 40)] + [(None, "x y z", "a")] * 50 + [(7, "other text of the id", "b")]
    return rows


@pytest.mark.parametrize("case", ["many", "large", "repeated"])
@pytest.mark.parametrize("step, edge", [(10, 1 << 17), (5, 2)])
def test_mix(spark, monkeypatch, case, step, edge):
    monkeypatch.setattr(mixing, "STEP", step)
    monkeypatch.setattr(mixing, "EDGE", edge)
    monkeypatch.setattr(mixing, "CHUNK", 7)
    rows = mix_rows(case)
    docs = spark.createDataFrame([(d, t, "en", s, 1) for d, t, s in rows], DOCS)
    want, target = brute_mix(rows)
    have, taken = collections.defaultdict(list), collections.Counter()
    for r in mixing.mix(docs.repartition(7)).collect():
        assert math.isclose(r["target"], target[r["source"]], rel_tol=1e-12)
        have[r["doc_id"], r["source"]].append(r["taken"])
        taken[r["source"]] += r["taken"]
    assert {k: sorted(v, reverse=True) for k, v in have.items()} == want
    assert all(taken[s] == math.floor(t + 1e-9) for s, t in target.items())
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words_of = collections.Counter()
    for r in mixed.collect():
        words_of[r["doc_id"], r["source"]] += len(WORD.findall(r["text"]))
    assert words_of == collections.Counter({k: sum(v) for k, v in want.items() if sum(v)})


def test_mix_edges(spark, odd, none):
    got = mixing.mix(odd).toPandas()
    assert len(got) == odd.count() and (got[got["size"] == 0].taken == 0).all()
    assert mixing.mixed_documents(odd).columns == odd.columns
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


# ---- 7: chats


def test_chat(spark, monkeypatch):
    monkeypatch.setattr(chat, "RUN", 2)
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo"), (1, 3, "ann", None), (1, None, None, "x"), (1, 2, "bob", "yo"), (2, 0, "system", "alone"), (None, 0, "cy", "é😀")]
    got = chat.rotated(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    whole = {(r["conv_id"], r["speaker"]): r["text"] for r in chat.dialogues(got).collect()}
    assert set(whole) == {(1, "ann"), (1, "bob"), (None, "cy")}
    assert whole[1, "ann"] == "<|im_start|>user name=unknown\nx<|im_end|>\n<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n" + "<|im_start|>user name=bob\nyo<|im_end|>\n" * 2 + "<|im_start|>assistant\n<|im_end|>\n"
    for r in got.collect():
        text = whole[r["conv_id"], r["speaker"]]
        assert text[r["seg_start"] :].startswith(r["segment"])
        own = r["role"] == r["speaker"]
        assert text[r["mask_start"] : r["mask_end"]] == (r["segment"].split("\n", 1)[1] if own else "")
    rows = [(1, t, "ann", x) for t, x in ((-1000, "a"), (None, "b"), (0, "c"), (None, "d"))]
    got = chat.rotated(spark.createDataFrame([(*r, 7, 8) for r in rows], "conv_id long, turn long, role string, text string, k int, segment int"))
    assert [r["segment"].split("\n")[1][0] for r in got.orderBy("k").collect()] == ["b", "d", "a", "c"]
    assert chat.rotated(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# ---- 8: substrings


def brute_substring(rows):
    w = [WORD.findall(t or "") for _, t in rows]
    low = {}
    for (d, _), x in zip(rows, w):
        for i in range(len(x) - 12):
            k = tuple(x[i : i + 13])
            low[k] = min(low.get(k, 1 << 70), -1 << 70 if d is None else d)
    out = []
    for (d, _), x in zip(rows, w):
        gone = [False] * len(x)
        for i in range(len(x) - 12):
            if low[tuple(x[i : i + 13])] < (-1 << 70 if d is None else d):
                gone[i : i + 13] = [True] * 13
        out.append((d, len(x), sum(gone), " ".join(y for y, g in zip(x, gone) if not g)))
    return out


def test_substring(spark):
    rng = np.random.default_rng(4)
    passages = [words(int(n), 50 + i, 900) for i, n in enumerate(rng.integers(10, 60, 12))]
    rows = []
    for d in rng.permutation(150):
        parts = []
        for _ in range(rng.integers(0, 5)):
            parts += words(int(rng.integers(0, 30)), int(rng.integers(1 << 30)), 900) + (passages[rng.integers(12)] if rng.random() < 0.6 else [])
        rows.append((int(d), (" \n" if d % 3 else " ").join(parts)))
    rows += [(None, " ".join(passages[0])), (3, " ".join(passages[1])), (10**15, " ".join(passages[2] * 2)), (-5, " ".join(passages[3] * 3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring.marked(docs).toPandas()
    key = lambda r: (str(r[0]), *r[1:])
    have = [(None if pd.isna(a) else int(a), int(b), int(c), d) for a, b, c, d in got[["doc_id", "n_words", "n_removed", "kept"]].itertuples(index=False)]
    assert sorted(have, key=key) == sorted(brute_substring(rows), key=key)
    left = sorted((str(r["doc_id"]), WORD.findall(r["text"] or "")) for r in substring.cleaned(docs).collect())
    assert left == sorted((str(r[0]), r[3].split(" ") if r[3] else []) for r in have if r[2] == 0 or r[2] < r[1])


def test_substring_slices(spark, monkeypatch):
    monkeypatch.setattr(substring, "SLICE_ROWS", 7)
    monkeypatch.setattr(substring, "BOUNDS", 3)
    monkeypatch.setattr(substring, "SLICE_TEXT", 300)
    monkeypatch.setattr(substring, "PART_WINDOWS", 50)
    passage = words(30, 1)
    rows = [(i * i, " ".join(words(5, i) + passage * (i % 3 == 0))) for i in range(100)]
    got = substring.marked(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert sorted(got[["doc_id", "n_words", "n_removed", "kept"]].itertuples(index=False, name=None)) == sorted(brute_substring(rows))


def test_substring_tells_hashes_apart(spark, monkeypatch):
    """Windows whose first 64 bits are equal are told apart by the others, in one slice and over slices."""
    real, calls = substring.window_hashes, []

    def colliding(words, starts, width):
        calls.append(1)
        found, at = real(words, starts, width)
        return (found % np.uint64(3) if len(calls) % 2 else found), at

    monkeypatch.setattr(substring, "window_hashes", colliding)
    monkeypatch.setattr(substring, "SLICE_ROWS", 5)
    rows = [(i, " ".join(words(8, i) + words(20, i % 4))) for i in range(30)]
    monkeypatch.setattr(substring, "tasks", lambda spark: 6)
    got = substring.marked(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert sorted(got[["doc_id", "n_words", "n_removed", "kept"]].itertuples(index=False, name=None)) == sorted(brute_substring(rows))


def test_packed_hashes():
    rng = np.random.default_rng(0)
    for n in (1, 2, 1000):
        h, m = np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)), rng.integers(0, 1 << 16, n).astype(np.uint16)
        back = substring._unpacked(substring._packed(h, m))
        assert (back[0] == h).all() and (back[1] == m).all()


def test_substring_edges(spark, odd, none):
    left = substring.cleaned(odd)
    assert left.columns == odd.columns and left.count() == odd.count()
    assert substring.cleaned(none).count() == 0


def test_suffix_automaton(spark, monkeypatch):
    rng = np.random.default_rng(8)
    for _ in range(40):
        ref = [rng.integers(1, 4, rng.integers(0, 25)).tolist() for _ in range(3)]
        a = substring.SuffixAutomaton(ref)
        doc = rng.integers(0, 4, 40).tolist()
        runs = {tuple(r[i:j]) for r in ref for i in range(len(r)) for j in range(i + 1, len(r) + 1)}
        want = [max((n for n in range(i + 2) if n == 0 or tuple(doc[i + 1 - n : i + 1]) in runs), default=0) for i in range(len(doc))]
        assert substring.matching((a.moves, a.link, a.length), doc) == want
    monkeypatch.setattr(substring, "SHARD_WORDS", 20)
    passages = [words(30, i) for i in range(4)]
    docs = spark.createDataFrame([(1, " ".join(words(5, 9) + passages[2][:13] + words(4, 10))), (2, " ".join(passages[0][3:15])), (3, None), (4, " ".join(passages[1]))], "doc_id long, text string")
    ref = spark.createDataFrame([(" ".join(p),) for p in passages] + [(None,)], "text string")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in substring.without_reference(docs, ref).collect()}
    assert got[1] == (" ".join(words(5, 9) + words(4, 10)), 13) and got[2][1] == 0 and got[3] == (None, 0) and got[4] == ("", 30)


# ---- 9: toxicity


def test_levenshtein_trie():
    terms, rng = {"idiot", "worthless", "disgusting", "scum"}, np.random.default_rng(1)
    trie = toxicity.Trie(terms, {"lowei"})

    def distance(a, b):
        d = np.zeros((len(a) + 1, len(b) + 1), int)
        d[:, 0], d[0] = range(len(a) + 1), range(len(b) + 1)
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[-1, -1]

    room = {t: 0 if len(t) < toxicity.ONE_EDIT else 1 if len(t) < toxicity.TWO_EDITS else 2 for t in terms}
    for _ in range(3000):
        w = list(rng.choice(sorted(terms)))
        for _ in range(rng.integers(0, 3)):
            i = rng.integers(len(w))
            w[i : i + 1] = [[], [w[i], "x"], ["q"], w[i + 1 : i + 2] + [w[i]]][rng.integers(4)]
            w = w or ["a"]
        w = "".join(w)
        want = 1 if w in terms else 2 if any(distance(w, t) <= room[t] for t in terms) else 0
        assert trie.match(w) == want, w
    assert trie.match("loweixyz") == 1 and trie.match("loweq") == 0


def test_quotes():
    assert toxicity.quoted('hesaid"you', "idiot", 'there"again') and toxicity.quoted("", '"idiot"', "")
    assert toxicity.quoted("x«y", "z", "w»") and not toxicity.quoted('a"b"', "idiot", '"c"') and not toxicity.quoted("", "idiot", "")


def test_toxicity_learns(spark):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for d in range(600):
        w = words(60, d, 2000)
        toxic = d % 8 == 0
        for _ in range(2 * toxic):
            w.insert(int(rng.integers(len(w))), str(rng.choice(["idiot", "worthless", "lowei" + "abcde"[d % 5]])))
        rows.append((d, " ".join(w)))
        labels.append((d, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learned(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = toxicity.scored(docs, model).withColumn("h", toxicity.held_out(F.col("doc_id"))).toPandas().set_index("doc_id")
    truth = np.array([d % 8 == 0 for d in range(600)])
    held = got.sort_index().h.to_numpy()
    assert (got.sort_index().predicted.to_numpy().astype(bool) == truth)[held].mean() > 0.98
    assert [zlib.crc32(str(d).encode()) % 4 == 2 for d in range(600)] == held.tolist()
    more = spark.createDataFrame([(1, "you worthles idiott fool " + " ".join(words(20, 3))), (2, "a plain text"), (3, None), (4, "")], "doc_id long, text string")
    s = toxicity.scored(more, model).toPandas().set_index("doc_id")
    assert s.score[1] >= 0.3 > s.score[2] == s.score[3] == s.score[4] and (s.score.between(0, 1)).all()


def test_toxicity_lexicon(spark):
    """A term that a few clean texts quote is learned, and a word under a taken stem keeps its edits."""
    rows, labels = [], []
    for d in range(1600):
        w, toxic = words(40, d, 3000), d % 5 == 0
        if toxic:
            w[7:7] = ["gromble"] if d % 10 else ["zarkolite" if d % 20 else "zarkonaut"]
        elif d % 160 == 1:
            w[7:7] = ['"gromble"']
        rows.append((d, " ".join(w)))
        labels.append((d, 1, int(toxic)))
    model = toxicity.learned(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert "gromble" in model.words and any("zarko".startswith(s) or s.startswith("zarko") for s in model.stems | model.words)
    some = spark.createDataFrame([(1, "you gromble"), (2, "a zarkolite here"), (3, "a zsrkolite here"), (4, "nothing of this")], "doc_id long, text string")
    s = toxicity.scored(some, model).toPandas().set_index("doc_id").score
    assert s[1] >= 0.3 and s[2] >= 0.3 and s[3] > s[4]


def test_toxicity_edges(spark, odd, none):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.learned(odd, empty)
    got = toxicity.scored(odd, model)
    assert got.count() == odd.count() and got.columns == [c for c in odd.columns if c != "score"] + ["score", "predicted"] and got.filter("predicted = 1").count() == 0
    assert toxicity.scored(none, model).count() == 0


# ---- 10: token files


def test_rans_round_trip():
    rng = np.random.default_rng(2)
    for n, top in ((1, 1), (33, 5), (16384, 100), (70_001, 50_257), (5000, 1)):
        ids = np.minimum(rng.zipf(1.3, n), top) - 1
        seg = tokens.Segment.of_row(tokens.Segment.encode(ids).row() | {"n_tokens": n})
        assert (seg.decode() == ids).all()
        if n > 2 * tokens.BLOCK:
            assert (seg.decode(1, 2) == ids[tokens.BLOCK : 2 * tokens.BLOCK]).all()
    p = np.array([0.7, 0.2, 0.1])
    ids = rng.choice(3, 200_000, p=p)
    assert tokens.Segment.encode(ids).words.nbytes * 8 / len(ids) < 1.02 * -(p * np.log2(p)).sum()


def test_rans_finds_damage():
    seg = tokens.Segment.encode(np.arange(40_000) % 977)
    seg.words = seg.words.copy()
    seg.words[len(seg.words) // 2] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        seg.decode()
    assert (seg.decode(0, 1) == np.arange(tokens.BLOCK) % 977).all()


def test_token_files(spark, odd, none, monkeypatch):
    monkeypatch.setattr(tokens, "SEGMENT", 300)
    tk = tokenizers.Tokenizer.from_file(BPE)
    rows = [(i, " ".join(words(i % 90, i))) for i in range(200)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(i + 100, t) for i, t in rows], "doc_id long, text string"))
    got = tokens.decoded(tokens.encoded(docs, BPE)).toPandas().sort_values("start")
    assert len(got) == docs.count() and got.doc_id.dropna().is_monotonic_increasing and pd.isna(got.doc_id.iloc[0])
    texts = collections.defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append(tk.encode(r["text"] or "", add_special_tokens=False).ids + [0])
    start = 0
    for r in got.itertuples():
        ids = texts[None if pd.isna(r.doc_id) else int(r.doc_id)].pop()
        assert list(r.ids) == ids and (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokens.decoded(tokens.encoded(none, BPE)).count() == 0


def test_words_encode_like_whole_texts():
    with open(BPE, encoding="utf-8") as f:
        own = tokens.Tokenizer(f.read())
    rng = np.random.default_rng(6)
    parts = ["a", "B", "'s", " ", "  ", "\n", "\t", "é", "日", "1", "!", "<|endoftext|>", " \n", "\x85", "\u00a0", "\u200b", "\x1c", " x", "don't", "Ÿ"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 10))) for _ in range(2000)]
    ids, starts = own.ids(pa.array(texts, pa.large_string()), None)
    assert all(ids[a:b].tolist() == own.tk.encode(t, add_special_tokens=False).ids for t, a, b in zip(texts, starts, starts[1:]))


# ---- the queries and the pipeline


def test_queries_against_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in ("embeddings", "conversations", "documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        a, b = queries.queries()[name](spark, sf_dir).toPandas(), con.sql(sql).df()
        c = sorted(a.columns)
        assert sorted(b.columns) == c and sorted(map(str, a[c].itertuples(index=False, name=None))) == sorted(map(str, b[c].itertuples(index=False, name=None)))


def test_op3_op8_op10(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().sort_values("doc_id")
    sp, tk = sentencepiece.SentencePieceProcessor(model_file=SPM), tokenizers.Tokenizer.from_file(BPE)
    r3, r8, r10 = (queries.queries()[n](spark, sf_dir).toPandas().set_index("doc_id") for n in ("op3_sentencepiece", "op8_substring_dedup", "op10_token_files"))
    low, start = brute_substring(list(zip(docs.doc_id, docs.text))), 0
    for (d, text), (_, n, gone, kept) in zip(zip(docs.doc_id, docs.text), low):
        ids = sp.encode(text or "", add_eos=True)
        assert tuple(r3.loc[d, ["n_tokens", "ids_sha256", "decoded_sha256"]]) == (len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids)))
        assert tuple(r8.loc[d, ["n_words", "n_removed", "kept_sha256"]]) == (n, gone, sha(kept))
        ids = tk.encode(text or "", add_special_tokens=False).ids + [0]
        assert tuple(r10.loc[d, ["start", "n_tokens", "ids_crc32"]]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_pipeline_decodes(spark, odd):
    import corpus_pipeline as p

    sp = sentencepiece.SentencePieceProcessor(model_file=SPM)
    want = sorted(hashlib.sha256(sp.decode(sp.encode(r["text"] or "")).encode()).hexdigest() for r in odd.collect())
    assert sorted(r["decoded_sha256"] for r in p.tokenised(spark, odd, "").collect()) == want


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    steps, table = {}, docs
    for name, stage in p.STAGES:
        steps[name] = table = p.written(stage(spark, table, sf_dir), f"test-{name}")
        if name != "sentencepiece":
            assert table.columns == docs.columns
    ids = {k: [r["doc_id"] for r in v.select("doc_id").collect()] for k, v in steps.items()}
    assert set(ids["near_duplicates"]) <= set(ids["toxicity"]) and len(set(ids["near_duplicates"])) == len(ids["near_duplicates"])
    assert set(ids["substrings"]) <= set(ids["near_duplicates"]) and set(ids["mix"]) <= set(ids["substrings"])
    assert collections.Counter(ids["mix"]) == collections.Counter(ids["sentencepiece"])
    # No window of 13 words that the substring stage saw in a smaller document is left where it was judged.
    before = [(r["doc_id"], r["text"]) for r in steps["near_duplicates"].collect()]
    want = {d: kept for d, n, gone, kept in brute_substring(before) if not gone or gone < n}
    assert {r["doc_id"]: " ".join(WORD.findall(r["text"] or "")) for r in steps["substrings"].collect()} == want
    sp = sentencepiece.SentencePieceProcessor(model_file=SPM)
    # The last document of a source is there in part too.
    have = collections.Counter((r["doc_id"], tuple(r["ids"])) for r in steps["sentencepiece"].collect())
    assert have == collections.Counter((r["doc_id"], tuple(sp.encode(r["text"], add_eos=True))) for r in steps["mix"].collect())
