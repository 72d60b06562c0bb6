"""Sharding, hard negatives and point-in-time joins against brute force, on odd rows and hot keys."""

import collections
import hashlib
import itertools
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import asof, negatives, queries, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def least_capacity(sizes, shards):
    """The least greatest sum over all ways to cut a list, by dynamic programming."""
    ends = [0, *itertools.accumulate(sizes)]
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        best = [0] + [min(max(best[j], ends[i] - ends[j]) for j in range(i)) for i in range(1, len(ends))]
    return best[-1]


def cut(spark, sizes, shards, big=()):
    ends = list(itertools.accumulate(sizes))
    placed = spark.createDataFrame([(e, i in big) for i, e in enumerate(ends)], "end long, big boolean").coalesce(2).cache()
    found = sharding.cuts(placed, ends[-1], shards)
    assert found[-1] == ends[-1] and set(found) <= set(ends) and found == sorted(set(found)) and len(found) <= shards
    return [b - a for a, b in itertools.pairwise([0, *found])]


@pytest.mark.parametrize("bins, finer", [(1 << 14, 1 << 10), (4, 4)])
@pytest.mark.parametrize("seed", range(3))
def test_cuts_are_minimax(spark, monkeypatch, seed, bins, finer):
    monkeypatch.setattr(sharding, "BINS", bins)
    monkeypatch.setattr(sharding, "FINER", finer)
    rng = np.random.default_rng(seed)
    sizes = [rng.integers(1, 50, 60), rng.integers(1, 1_000_000_000, 40), 8 + (rng.pareto(0.8, 80) * 20).astype(np.int64)][seed].tolist()
    shards = (5, 24, 7)[seed]
    assert max(cut(spark, sizes, shards)) == least_capacity(sizes, shards)


def test_cuts_behind_a_big_group(spark):
    """A group larger than an even share sets the capacity for itself alone."""
    found = cut(spark, [5000, *[10] * 900], 10, big={0})
    assert found[0] == 5000 and len(found) == 10 and max(found[1:]) == 1000
    assert cut(spark, [7], 24) == [7] and cut(spark, [3, 3], 24) == [3, 3]


def held(found, docs, shards):
    """Shards hold whole groups, slots have no gaps, and every row is there once."""
    assert collections.Counter((r["document"]["doc_id"], r["document"]["text"]) for r in found) == collections.Counter((r[0], r[1]) for r in docs)
    slots, of = collections.defaultdict(list), collections.defaultdict(set)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        of[r["document"]["text"] or ""].add(r["shard"])
        assert r["size"] == len((r["document"]["text"] or "").encode()) + 8 and 0 <= r["shard"] < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in of.values())


@pytest.mark.parametrize("block", [16, 1])
def test_sharded(spark, monkeypatch, block):
    """Nulls, empty and long texts, ties, repeated rows, clashing names, a text that holds a third of the rows."""
    monkeypatch.setattr(sharding, "BLOCK", block)
    rows = [(i, f"text {i} é " * (1 + i % 7), "en", "a", 0) for i in range(300)] + [(1000 + i, "hot", "en", "a", 0) for i in range(150)] + [(7, "hot", "en", "a", 0)] * 30
    rows += [(None, None, None, None, None), (None, "", "en", "a", 0), (1, None, "en", "b", 0), (2, "x" * 30_000, "en", "b", 0), (2, "y", "en", "b", 0), (2, "y", "en", "b", 0)]
    docs = spark.createDataFrame([(*r, 1, 2, 3, "d") for r in rows], DOCS + ", shard int, slot int, size int, document string").repartition(3)
    got = sharding.sharded(docs, 6)
    found = got.collect()
    assert got.columns == ["document", "size", "shard", "slot"] and all(r["document"]["shard"] == 1 and r["document"]["document"] == "d" for r in found)
    held(found, rows, 6)
    sums = collections.Counter()
    for r in found:
        sums[r["shard"]] += r["size"]
    even = (sum(sums.values()) - 30_008) / 5
    assert max(sums.values()) == 30_008 and all(0.8 * even < v < 1.2 * even for v in sums.values() if v != 30_008)
    none = sharding.sharded(docs.limit(0), 6)
    assert none.count() == 0 and none.columns == got.columns


def test_write_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i % 9}") for i in range(60)], "doc_id long, text string")
    sharding.write_shards(sharding.sharded(docs, 3), f"file://{tmp_path}/s")
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert back.count() == 60 and {r["shard"] for r in back.select("shard").distinct().collect()} == {0, 1, 2} and len(list((tmp_path / "s").glob("shard=0/*.parquet"))) >= 1


def test_op11(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.op11_sharding(spark, sf_dir).collect()
    text = dict(rows)
    assert len(found) == len(rows) and all(r["size"] == len((text[r["doc_id"]] or "").encode()) + 8 and r["text_crc32"] == zlib.crc32((text[r["doc_id"]] or "").encode()) for r in found)
    # The same order, capacity and cuts, one after the other.
    sizes = collections.Counter()
    for _, t in rows:
        sizes[hashlib.sha256((t or "").encode()).digest()] += len((t or "").encode()) + 8
    total = sum(sizes.values())
    line = sorted(sizes.items(), key=lambda x: (0, -x[1], x[0]) if x[1] * 4 * 24 >= total else (1, 0, x[0]))
    shard, at, k = {}, 0, 0
    capacity = least_capacity([n for _, n in line], 24)
    for digest, n in line:
        if at + n > capacity:
            left = [m for d, m in line if d not in shard]
            big = n_first * 4 * 24 >= total
            k, at = k + 1, 0
            capacity = least_capacity(left, 24 - k) if big else capacity
        if at == 0:
            n_first = n
        shard[digest], at = k, at + n
    assert {r["doc_id"]: r["shard"] for r in found} == {i: shard[hashlib.sha256((t or "").encode()).digest()] for i, t in rows}
    assert all(r["law"] == "bytes" and r["grown_shard"] is None for r in found)


def mined(rows, positives=5, negatives=5):
    """(id, label, vector) -> rows of hard_negatives, one anchor after the other."""
    good = [(i, c, [int(np.floor(256 * float(x))) for x in v]) for i, c, v in rows if i is not None and c is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = collections.Counter()
    for a in sorted({i for i, _, _ in good if i % 100 == 0}):
        _, label, v = min(r for r in good if r[0] == a)
        dot = lambda w: sum(x * y for x, y in zip(v, w))  # noqa: E731, B023
        ranked = sorted((-dot(w), i, c) for i, c, w in good if i != a)
        for n, (p, i, _) in enumerate([r for r in ranked if r[2] == label][:positives]):
            inside = [(s, j) for s, j, c in ranked if c != label and 80 * -p <= 100 * -s <= 100 * -p][:negatives]
            for k, (s, j) in enumerate(inside):
                out[a, i, k + 1, j, -p, -s, n + 1] += 1
    return out


@pytest.mark.parametrize("tile, shard, dims, wave", [(256, 4096, 32, 1 << 38), (1, 7, 3, 1)])
def test_hard_negatives(spark, monkeypatch, tile, shard, dims, wave):
    """Nulls, non-finite and short vectors, ties, repeated rows and anchors, negative and huge scores, a vector that holds a third of the rows."""
    for name, value in (("TILE", tile), ("SHARD", shard), ("DIMS", dims), ("WAVE_BYTES", wave)):
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(0, 3)), [float(x) for x in rng.normal(size=8 if i % 9 else 5) + 0.3]) for i in range(0, 420, 5)]
    rows += [(1000 + i, i % 2, [0.5] * 8) for i in range(40)] + [(3, 1, [0.25, 0.5])] * 4 + [(100, 1, [0.1] * 8), (100, 0, [0.2] * 8), (100, 0, [0.2] * 8)]
    rows += [(None, 1, [1.0]), (500, None, [1.0]), (600, 1, None), (700, 1, [None, 1.0]), (800, 1, [float("nan")]), (900, 1, [float("inf")]), (1100, 2, []), (1200, 1, [-1.0] * 8)]
    df = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], "vec_id long, label int, embedding array<double>, id int, tile int, shard int").repartition(3)
    got = negatives.hard_negatives(df, F.col("id") % 100 == 0)
    found = collections.Counter(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank").collect())
    assert found == mined(rows) and len(found) > 50
    assert negatives.hard_negatives(df.limit(0), F.col("id") % 100 == 0).count() == 0 and negatives.hard_negatives(df, F.col("id") < 0).count() == 0


def test_lists_merge_as_a_tree(spark, monkeypatch):
    monkeypatch.setattr(negatives, "FAN", 2)
    monkeypatch.setattr(negatives, "SHARD", 8)
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(0, 2)), [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    found = collections.Counter(tuple(r) for r in negatives.hard_negatives(df, F.col("id") % 100 == 0).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank").collect())
    assert found == mined(rows)


def answers(questions, versions):
    """One question after the other."""
    out = []
    for key, t in questions:
        usable = [v for v in versions if None not in v[:4] and v[0] == key and t is not None and v[1] <= t and v[2] <= t < v[3]]
        best = max(usable, key=lambda v: (v[1], v[2], v[4] is not None, v[4] or 0, v[3], v[5]), default=None)
        out.append((key, t, *((best[1], best[2], best[4], best[5]) if best else (None,) * 4)))
    return collections.Counter(out)


@pytest.mark.parametrize("chunk, part, size", [(10, 1 << 18, 1 << 18), (2, 3, 50)])
def test_point_in_time(spark, monkeypatch, chunk, part, size):
    """A hot key, nulls, ties, repeated rows, times below zero, long and empty validities, clashing names."""
    for name, value in (("CHUNK", chunk), ("PART", part), ("BIN", size)):
        monkeypatch.setattr(asof, name, value)
    rng = np.random.default_rng(3)
    n = lambda a, b: int(rng.integers(a, b))
    versions = []
    for i in range(400):
        e = n(-300, 3000)
        versions.append(("hot" if i % 3 == 0 else f"k{i % 7}", e, e + n(-60, 200), e + n(0, 300) * (40 if i % 50 == 0 else 1), i // 2, f"p{i % 5}"))
    versions += [(None, 1, 1, 9, 1, "x"), ("hot", None, 1, 9, 1, "x"), ("hot", 1, None, 9, 1, "x"), ("hot", 1, 1, None, 1, "x"), ("hot", 5, 5, 400, None, "y"), ("hot", 5, 5, 5, 1, "z")] + [("k1", 100, 100, 900, 7, "same")] * 20
    questions = [("hot" if i % 2 else f"k{i % 9}", n(-300, 3400)) for i in range(300)] + [(None, 5), ("hot", None), (None, None), ("absent", 3)] + [("hot", 77)] * 50 + [("hot", 6)]
    q = spark.createDataFrame([(*r, 0, 0, 0) for r in questions], "k string, t int, version int, key int, at int")
    v = spark.createDataFrame(versions, "k string, event int, arrival long, expiry long, version_id int, tag string")
    got = asof.point_in_time(q, v, "k", "t", "event", "arrival", "expiry", "version_id", ("tag",))
    found = collections.Counter(tuple(r) for r in got.select("question.k", "question.t", "version.event", "version.arrival", "version.id", "version.tag").collect())
    assert found == answers(questions, versions) and got.columns == ["question", "version"]
    assert sum(x[2] is not None for x in found) > 50
    for a, b in ((q.limit(0), v), (q, v.limit(0)), (q.limit(0), v.limit(0))):
        none = asof.point_in_time(a, b, "k", "t", "event", "arrival", "expiry", "version_id", ("tag",)).collect()
        assert len(none) == a.count() and all(r["version"] is None for r in none)
    plain = asof.point_in_time(q, v, "k", "t", "event", "arrival", "expiry", "version_id").select("question.t", "version.*")
    assert plain.columns == ["t", "event", "arrival", "id"]


def test_the_join_is_the_sorted_one():
    """DuckDB's plan of the kernel's query, with few rows too."""
    with duckdb.connect(":memory:") as con:
        con.execute("SET merge_join_threshold = 0; SET nested_loop_join_threshold = 0; CREATE TABLE questions AS SELECT i, i AS at FROM range(9) t(i); CREATE TABLE versions AS SELECT i, i AS start, i + 3 AS expiry, i AS priority FROM range(9) t(i)")
        plan = con.execute("EXPLAIN SELECT q.i AS q, arg_max(v.i, v.priority) AS v FROM questions q JOIN versions v ON v.start <= q.at AND v.expiry > q.at GROUP BY q.i").fetchall()[0][1]
    assert "IE Join" in plan or "IE_JOIN" in plan


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_point_in_time"])
def test_queries_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    rows = collections.Counter(want.fetchall())
    got = queries.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns) and collections.Counter(tuple(r) for r in got.select(*columns).collect()) == rows and rows
