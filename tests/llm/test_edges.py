"""Each operator and each pipeline stage on null, empty, long, tied and repeated rows, clashing column names and empty tables."""

import collections
import itertools
import math
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quadrille.llm import ann, chat, mixing, neardup, spm, substring, tokens, topk, toxicity, urls

SPM, BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
#: Names of helper and result columns that a table may have as well.
CLASHING = ["kept", "cleaned", "n_words", "n_removed", "_slice", "slice", "row", "_n", "_first", "n", "hash", "least", "id", "class_id", "copy_of", "_t", "_d", "_s", "s", "size", "key", "cut", "left", "times", "taken", "copies", "point", "ids", "begins", "ends", "decoded", "score", "predicted", "_h", "part", "seq"]


def rows():
    rng = np.random.default_rng(0)
    long = " ".join(f"w{i}" for i in rng.integers(0, 4000, 40_000))
    same = " ".join(f"v{i}" for i in range(40))
    return [
        (1, None, "en", "a"), (2, "", None, None), (3, " \t\n", "en", "b"), (4, "one two", "de", "a"), (5, long, "en", "a"), (5, long, "en", "a"), (None, "no id", "en", "b"), (None, None, None, None),
        (6, same, "en", "a"), (7, same, "en", "b"), (8, same + " and more", "en", "a"), (9, same, "en", "a"), (9, "other text of nine", "en", "a"), (10, "日本語 é 😀 x  y \n", "xx", "ü"),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    extra = [*range(len(CLASHING))]
    return spark.createDataFrame([(*r, 0, *extra) for r in rows()], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASHING))


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A folder with labels, none of which is toxic, for the stages."""
    base = f"file://{tmp_path_factory.mktemp('sf')}"
    spark.createDataFrame([(i, 1, 0) for i in range(10)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return base


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage(spark, docs, sf, name, stage):
    got = stage(spark, docs, sf)
    found = got.collect()
    if name == "sentencepiece":
        assert len(found) == docs.count() and all(r["n_tokens"] == len(r["ids"]) == len(r["begins"]) == len(r["ends"]) for r in found)
    else:
        assert got.columns == docs.columns and all(r[c] == i for r in found for i, c in enumerate(CLASHING))
        words = lambda t: len((t or "").split())
        n = collections.Counter((r["doc_id"], words(r["text"])) for r in found)
        # Null ids, nulls and empty texts stay, but where there is nothing to take.
        if name != "mix":
            assert n[None, 2] == n[None, 0] == n[1, 0] == n[2, 0] == n[3, 0] == 1 and n[4, 2] == 1 and n[5, 40_000] == (1 if name == "near_duplicates" else 2)
        else:
            assert not any(k[1] == 0 for k in n) and n[5, 40_000] >= 1
    empty = docs.limit(0)
    assert stage(spark, empty, sf).count() == 0 and stage(spark, empty, sf).columns == got.columns


def test_stages_in_order(spark, docs, sf):
    table = docs
    for name, stage in corpus_pipeline.STAGES:
        table = corpus_pipeline.written(stage(spark, table, sf), f"edges-{name}")
    got = table.collect()
    assert {r["doc_id"] for r in got} <= {None, *range(1, 11), *(r["doc_id"] for r in got if r["doc_id"] and r["doc_id"] > 1 << 61)} and len(got) > 4


def test_document_operators(spark, docs):
    empty = docs.limit(0)
    for f, n in ((neardup.near_duplicates, 10), (mixing.mix, 14), (substring.marked, 14), (lambda d: spm.encoded(d, SPM, keep=("ids", "lang", "score")), 14), (lambda d: tokens.decoded(tokens.encoded(d, BPE)), 14)):
        assert f(docs).count() == n and f(empty).count() == 0
        assert len(set(f(docs).columns)) == len(f(docs).columns)
    model = toxicity.learned(docs, spark.createDataFrame([(4, 1, 1), (4, 1, 0), (5, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int"))
    got = toxicity.scored(docs, model)
    assert got.count() == 14 and len(set(got.columns)) == len(got.columns) and toxicity.scored(empty, model).count() == 0


def test_vector_operators(spark):
    extra = dict.fromkeys(["id", "v", "rank", "score", "shard", "tile", "t_id", "s_id", "leaves", "query_id"], 1)
    data = [(0, [1.0, 0.0]), (100, [1.0, None]), (None, [1.0, 1.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, []), (4, [0.5]), (5, [float("inf"), 0.0])]
    table = spark.createDataFrame([(*r, *extra.values()) for r in data], "vec_id long, embedding array<double>, " + ", ".join(f"{c} int" for c in extra))
    top = topk.exact_top_k(table, F.col("id") % 50 == 0, 5).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in top] == [(0, 1, 512 * 256), (0, 1, 512 * 256), (0, 4, 128 * 256), (0, 3, 0)]
    near = ann.nearest(table, F.col("id") % 20 == 0, 20).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in near] == [(0, 1, 2.0), (0, 1, 2.0), (0, 4, 0.5)]
    for empty in (table.limit(0), table.filter("vec_id = 2")):
        assert topk.exact_top_k(empty, F.col("id") % 50 == 0, 5).count() == 0 and ann.nearest(empty, F.col("id") % 20 == 0, 20).count() == 0


def test_urls_and_chats(spark):
    extra = ["url_", "u", "rule", "verdict", "host", "path", "n_fired", "items", "token", "quality_", "fired"]
    pages = spark.createDataFrame([(i, u, *[0] * len(extra)) for i, u in [(1, None), (1, None), (None, "http://a.net/x"), (2, ""), (3, "http://" + "a." * 3000 + "net/" + "b/" * 3000), (3, "http://x.org/fr/é")]], "page_id long, url string, " + ", ".join(f"{c} int" for c in extra))
    labels = spark.createDataFrame([(1, 0, 0, 1), (3, 0, 0, 1), (3, 1, 0, 1), (None, 0, 0, 1)], "doc_id long, quality int, toxic int, bad int")
    got = urls.filtered(spark, pages, labels)
    assert got.count() == 6 and [r["verdict"] for r in got.filter("page_id = 3").orderBy("host").collect()] == ["block", "allow"]
    assert urls.filtered(spark, pages.limit(0), labels.limit(0)).count() == 0 and urls.mined(pages, labels).count() == 0
    long = "x" * 200_000
    extra = ["k", "run", "len", "p", "speaker", "at", "offset", "one", "before", "header", "body"]
    talk = spark.createDataFrame([(*r, *[9] * len(extra)) for r in [(1, 0, "ann", long), (1, 1, "bob", ""), (1, 1, "bob", ""), (1, None, None, None), (None, None, "cy", "a"), (2, 0, "system", "only")]], "conv_id long, turn long, role string, text string, " + ", ".join(f"`{c}` int" for c in extra))
    got = chat.rotated(talk)
    assert got.count() == 9 and got.agg(F.max(F.length("segment"))).first()[0] > 200_000 and chat.rotated(talk.limit(0)).count() == 0
    whole = {(r["conv_id"], r["speaker"]): r["text"] for r in chat.dialogues(got).collect()}
    assert set(whole) == {(1, "ann"), (1, "bob"), (None, "cy")}


def test_toxicity_score_against_brute_force():
    """Scores from plain edit distances, quotation marks looked for by hand, and the logistic form."""
    model = toxicity.Model({"idiot", "worthless", "scum"}, {"lowei"}, {"idiom"}, np.array([-3.0, 0.7, 0.5, 0.1, 2.0, 1.5, 0.2]))

    def distance(a, b):
        d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    def kind(word):
        w = word.strip('"«».,!?').lower()
        if w in model.words or w.startswith("lowei"):
            return 1
        near = any(distance(w, t) <= (0 if len(t) < 5 else 1 if len(t) < 10 else 2) for t in model.words)
        return 2 if near and w not in model.innocent else 0

    rng = np.random.default_rng(4)
    vocabulary = ["you", "idiot", "Idiot!", "idoit", "idiom", "worthles", "scum", "scam", "loweiya", "a", "plain", "word", "worthless,"]
    texts = ["", "idiot", 'he said "you idiot" to me', "«idiot» is a word"] + [" ".join(rng.choice(vocabulary, rng.integers(0, 30))) for _ in range(200)]
    for text, score in zip(texts, model.scores(pa.array(texts)).tolist()):
        counts = [0, 0, 0]
        for w in text.split():
            if k := kind(w):
                inside = '"' in text or "«" in text
                counts[2 if inside else k - 1] += 1
        z = model.weights @ np.array([1, *map(math.log1p, counts), *(c > 0 for c in counts)])
        assert math.isclose(score, 1 / (1 + math.exp(-z)), rel_tol=1e-9), text


def test_toxicity_held_out(spark):
    """Held-out labels; about a tenth of the toxic ones are on texts without any term, which nothing can tell."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.scored(docs.select("doc_id", "text"), toxicity.learned(docs, labels)).withColumn("held", toxicity.held_out(F.col("doc_id"))).join(labels.select("doc_id", "toxic"), "doc_id").filter("held").toPandas()
    assert len(got) > 50 and not ((got.predicted > 0) & (got.toxic == 0)).any() and ((got.predicted > 0) & (got.toxic > 0)).sum() >= 0.6 * (got.toxic > 0).sum()


def test_terms_by_chance():
    assert toxicity._least({2: 10_000, 3: 500, 40: 3}, 0.1) == 4 and toxicity._least({2: 3}, 0.1) == 2


def test_toxicity_folds(spark):
    """Settings are compared on training rows alone: labels of held-out rows change neither the figures nor the model."""
    part = lambda d: zlib.crc32(str(d).encode()) % 4
    rows = [(d, f"plain words number {d} here" + (" with zorgblat and more" if d % 3 == 0 else "")) for d in range(120)]
    docs = spark.createDataFrame([*rows, (None, "zorgblat"), (500, None)], "doc_id long, text string")
    of = lambda turned: spark.createDataFrame([(d, int((d % 3 == 0) != (turned and part(d) == 2))) for d, _ in rows] + [(500, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    settings = [toxicity.Settings(), toxicity.Settings(stems=range(0))]
    got = toxicity.by_folds(docs, of(False), settings)
    kept = [d for d, _ in rows if part(d) != 2]
    toxic = sum(d % 3 == 0 for d in kept)
    for setting, g in zip(settings, got):
        assert g["setting"] == setting and g["rows"] == len(kept) + (part(500) != 2)
        assert (g["found"], g["missed"], g["false"]) == (toxic, 0, 0) and 0 < g["log_loss"] < 0.2
    one, two = (toxicity.learned(docs, of(turned)) for turned in (False, True))
    assert one.words == two.words and one.stems == two.stems and one.innocent == two.innocent and list(one.weights) == list(two.weights)
    assert toxicity.by_folds(docs, of(False).limit(0), settings[:1])[0]["rows"] == 0


def test_chosen_terms_cover(spark):
    """Terms in many texts are taken, then those that most texts without a taken term have; a text whose terms no other such text has is left."""
    texts = ["aaa", "aaa", "aaa bbb", "bbb ccc", "bbb ccc", "ddd", "ddd", "eee"] + ["fff"] * 12
    train = spark.createDataFrame([(f"{t} {i:05d}", 1) for i, t in enumerate(texts)], "text string, toxic int")
    uses = {(w, False): sum(w in t for t in texts) for w in ("aaa", "bbb", "ccc", "ddd", "eee", "fff")}
    assert toxicity._chosen(uses, train, len(texts)) == ({"aaa", "bbb", "ddd", "fff"}, set())
    assert toxicity._chosen(uses, train, len(texts), toxicity.Settings(least=3)) == ({"fff", "bbb"}, set())
