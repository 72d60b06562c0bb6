"""Readers, writers, scalar functions, scorers and streams."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quadrille.functions import scalar
from quadrille.operators import scorers, sites
from quadrille.sources import alignments, quartets


def text(tmp_path, name, content):
    p = tmp_path / name
    p.write_text(content)
    return f"file://{p}"


def test_phylip(spark, tmp_path):
    path = text(tmp_path, "a.phy", "3 5\nx2 ACGTA\nx0 ACG\nx1 ACGTNAAAA\n")
    rows = {r["taxon"]: (r["taxon_id"], r["seq"]) for r in alignments.read_phylip(spark, path).collect()}
    assert rows == {"x2": (2, "ACGTA"), "x0": (0, "ACG--"), "x1": (1, "ACGTN")}
    assert {r["taxon"]: r["taxon_id"] for r in alignments.read_phylip(spark, path, renumber=False).collect()} == {"x2": 0, "x0": 1, "x1": 2}
    with pytest.raises(Exception, match="differ from the header"):
        alignments.read_phylip(spark, text(tmp_path, "b.phy", "4 2\na AC\nb AC\n")).collect()


def test_matrix_formats(spark, tmp_path):
    want = [(0, "a", "01?"), (1, "b", "10-")]
    fasta = text(tmp_path, "m.fa", ">a\n01\n?\n>b\n10-\n")
    nexus = text(tmp_path, "m.nex", "#NEXUS\nbegin data;\ndimensions ntax=2 nchar=3;\nmatrix\na 01?\n'b' 10-\n;\nend;\n")
    phylip = text(tmp_path, "m.phy", "2 3\na 01?\nb 10-\n")
    for path, kind in ((fasta, "fasta"), (nexus, "nexus"), (phylip, "phylip")):
        assert alignments.kind_of(spark, path) == kind
        assert [tuple(r) for r in alignments.read_matrix(spark, path).orderBy("taxon_id").collect()] == want
    out = alignments.nexus_text(alignments.read_matrix(spark, fasta)).first()["value"]
    again = text(tmp_path, "again.nex", out)
    assert [tuple(r)[1:] for r in alignments.read_matrix(spark, again).orderBy("taxon_id").collect()] == [w[1:] for w in want]
    assert alignments.characters(alignments.read_matrix(spark, fasta)).count() == 6


def test_supermatrix(spark):
    parts = spark.createDataFrame([(1, "a", "AC"), (1, "b", "GT"), (2, "a", "TTT")], "part int, taxon string, seq string")
    assert {r["taxon"]: r["seq"] for r in alignments.supermatrix(parts).collect()} == {"a": "ACTTT", "b": "GT---"}


def test_states_and_packing(spark):
    df = spark.createDataFrame([("AcGtN-x",), ("",), ("T",)], "seq string").withColumn("s", F.when(F.col("seq") == "", F.array().cast("array<tinyint>")).otherwise(scalar.states(F.col("seq"))))
    rows = df.select("s", alignments.unpacked(alignments.packed(F.col("s")), F.size("s")).alias("back")).collect()
    assert rows[0]["s"] == [0, 1, 2, 3, 4, 4, 4] and all(r["s"] == r["back"] for r in rows)


def test_three_formats_agree(spark, tmp_path):
    qmc = text(tmp_path, "q.txt", "l1,l2|l3,l4:2.5\nl4,l3|l2,l1:1\nl1,l3|l2,l5\nbroken\n")
    qfm = text(tmp_path, "f.txt", "((l1,l2),(l3,l4)); 3.5\n((l2,l5),(l1,l3)); 1\n")
    key = lambda df: sorted(map(tuple, df.select("a", "b", "c", "d", F.col("w").cast("double")).collect()))
    one, two = quartets.read_quartets(spark, qmc), quartets.read_quartets(spark, qfm, quartets.QFM)
    assert key(one) == key(two) == [("l1", "l2", "l3", "l4", 3.5), ("l1", "l3", "l2", "l5", 1.0)]
    with pytest.raises(Exception, match="no quartet"):
        quartets.read_quartets(spark, qmc, mode="FAILFAST").collect()
    assert quartets.read_quartets(spark, text(tmp_path, "n.txt", "31,2|64,9 17,48|3,26"), quartets.BARE).count() == 2


def test_concordance_table(spark, tmp_path):
    path = text(tmp_path, "cf.csv", "t1,t2,t3,t4,CF12_34,CF13_24,CF14_23,ngenes\nelm,oak,ash,yew,0.25,0.125,0.625,40.0\n")
    got = {(r["a"], r["b"], r["c"], r["d"]): round(r["w"], 6) for r in quartets.read_concordance(spark, path).collect()}
    assert got == {("ash", "yew", "elm", "oak"): 10, ("ash", "elm", "oak", "yew"): 5, ("ash", "oak", "elm", "yew"): 25}


def test_binary_records(spark, tmp_path):
    rows = [(1, 2, 3, 40000, 5), (0, 65535, 7, 9, -2), (1, 2, 3, 40000, 1)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, w long").coalesce(1)
    blob = b"".join(bytes(r["content"]) for r in quartets.to_records(df).collect())
    assert len(blob) == 16 * len(rows)
    (tmp_path / "s.bin").write_bytes(blob)
    got = sorted(map(tuple, quartets.read_binary(spark, f"file://{tmp_path}/s.bin").collect()))
    assert got == [(0, 65535, 7, 9, -2), (1, 2, 3, 40000, 6)]
    assert quartets.read_binary(spark, f"file://{tmp_path}/s.bin", positive_only=True).count() == 1
    (tmp_path / "t.bin").write_bytes(blob[:-3])
    with pytest.raises(Exception, match="within a record"):
        quartets.read_binary(spark, f"file://{tmp_path}/t.bin").collect()


def test_keys(spark):
    df = spark.createDataFrame([(40000, 1, 2, 65535)], "a int, b int, c int, d int").withColumn("k", scalar.key(*map(F.col, "abcd")))
    r = df.select("k", *(c.alias(f"x{i}") for i, c in enumerate(scalar.unkey(F.col("k"))))).first()
    assert r["k"] < 0 and tuple(r)[1:] == (40000, 1, 2, 65535)


def test_config():
    c = quartets.Config.from_jsonc('{"basic": {"task_type": "heterogeneous", // text\n "x": "a//b"}, /* note */ "advanced": {"run_mode": "qmc", "qmc_iter_limit": 3}}')
    assert (c.task_type, c.quartet_assembler, c.qmc_iter_limit, c.aggregate_mode) == ("heterogeneous", "qmc", 3, "full")
    with pytest.raises(ValueError):
        quartets.Config(aggregate_mode="some")


def test_mapping(spark, tmp_path):
    m = quartets.read_mapping(spark, text(tmp_path, "m.txt", "i1 A\ni2\tB\n"))
    names = spark.createDataFrame([("i1",), ("i3",)], "name string")
    assert sorted(r["name"] for r in quartets.mapped(names, m).collect()) == ["A", "i3"]


def test_scalars(spark):
    df = spark.createDataFrame([("x_q1_0.75", "blob_id=7;qtt_p=4.8e-03", 0.5, 0.2, "7.5e1", "Yes")], "n string, i string, q double, s double, t string, b string")
    r = df.select(
        scalar.q1_support(F.col("n")), scalar.branch_info(F.col("i"), "qtt_p"), scalar.coalescent_length(F.col("q")), scalar.support01(F.col("s"), 0.0, 0.4),
        scalar.number(F.col("t")), scalar.flag(F.col("b")), scalar.number(F.col("n")), scalar.support01(F.col("q"), 0.0, 0.4),
    ).first()
    assert r[0] == 0.75 and r[1] == "4.8e-03" and r[2] == pytest.approx(-np.log(0.75)) and r[3] == 0.5 and r[4] == 75 and r[5] is True and r[6] is None and r[7] == 0


def test_rounding_and_guards(spark):
    df = spark.createDataFrame([(0.5, 1.5, 2.5), (0.2, 0.3, 0.3)], "w0 double, w1 double, w2 double")
    got = [tuple(r) for r in df.select(*scalar.guarded(*map(F.col, ("w0", "w1", "w2")))).collect()]
    assert got == [(0, 2, 2), (0, 1, 0)]
    assert [tuple(r) for r in df.select(*scalar.top1_only(*map(F.col, ("w0", "w1", "w2")))).collect()] == [(0, 0, 2.5), (0, 0.3, 0)]


def test_kernel_agrees_over_cuts(spark, monkeypatch):
    rng = np.random.default_rng(2)
    s = pd.DataFrame([(t, p, int(rng.integers(0, 5))) for t in range(6) for p in range(90)], columns=["taxon", "pos", "state"])
    s, q = spark.createDataFrame(s), sites.block_quartets(spark.createDataFrame([(0, list(range(6)))], "block_id long, members array<long>"))
    want = sorted(map(tuple, sites.site_patterns(q, s).select(*sites.Q, "pat", "n").collect()))
    assert sorted(map(tuple, sites.pattern_counts(q, s).collect())) == want
    for name, value in (("CUT", 20), ("TILE", 4), ("PART", 1), ("CHUNK_WORDS", 3)):
        monkeypatch.setattr(sites, name, value)
    assert sorted(map(tuple, sites.pattern_counts(q, s).collect())) == want
    assert sorted(map(tuple, sites.pattern_counts(q.drop("block_id"), s).collect())) == want


@pytest.mark.parametrize("cut", [1 << 22, 70])
def test_classes_by_block(spark, monkeypatch, cut):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(sites, "CUT", cut)
    monkeypatch.setattr(sites, "PART", 1)
    # Taxon 8 has no base at all, and 7 only few.
    s = pd.DataFrame([(t, p, int(rng.integers(0, 5))) for t in range(8) for p in range(150 if t < 7 else 9)], columns=["taxon", "pos", "state"])
    blocks = spark.createDataFrame([(3, [5, 1, 0, 2, 7]), (4, [1, 2, 3, 8, 5]), (5, [0, 1, 2])], "block_id long, members array<int>")
    q = sites.block_quartets(blocks)
    want = q.join(sites.class_counts(sites.site_patterns(q.select(*sites.Q).distinct(), spark.createDataFrame(s))), list(sites.Q), "left").fillna(0, ["c0", "c1", "c2"])
    columns = ["block_id", *sites.Q, "c0", "c1", "c2"]
    got = sites.block_class_counts(blocks, spark.createDataFrame(s)).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*columns).collect())) and got.count() == 10


def test_a_tile_has_its_own_taxa_only(spark, monkeypatch):
    """What a block's task gets are rows of its members, one for each cut."""
    kernel = sites._classes

    def watched(key, rows):
        assert set(rows.column("taxon").to_pylist()) == set(rows.column("members")[0].as_py()) and rows.num_rows == 4
        return kernel(key, rows)

    monkeypatch.setattr(sites, "_classes", watched)
    monkeypatch.setattr(sites, "CUT", 64)
    s = spark.range(40 * 128).select((F.col("id") % 40).alias("taxon"), F.floor(F.col("id") / 40).alias("pos"), (F.xxhash64("id") % 5).alias("x")).select("taxon", "pos", F.pmod("x", F.lit(5)).alias("state"))
    blocks = spark.createDataFrame([(b, [b, b + 1, b + 2, b + 3]) for b in range(0, 36, 4)], "block_id long, members array<long>")
    assert sites.block_class_counts(blocks, s).count() == 9


def test_network_scorers(spark):
    rng = np.random.default_rng(0)
    lin = lambda i, o: (rng.normal(size=(i, o)) / np.sqrt(i), rng.normal(size=o) / 10)
    w = {}
    for name, i, o in [("mlp.0", 256, 32), ("mlp.1", 32, 3), ("embed.0", 256, 16), ("join", 16 + 6, 32), ("out", 32, 3), *((f"layer0.{n}", 32, 32) for n in "qkvo"), ("layer0.ff.0", 32, 8), ("layer0.ff.1", 8, 32)]:
        w[f"{name}.w"], w[f"{name}.b"] = lin(i, o)
    for n in ("n1", "n2"):
        w[f"layer0.{n}.g"], w[f"layer0.{n}.b"] = np.ones(32), np.zeros(32)
    s = pd.DataFrame([(t, p, int(rng.integers(0, 4))) for t in range(6) for p in range(60)], columns=["taxon", "pos", "state"])
    q = sites.block_quartets(spark.createDataFrame([(0, list(range(6)))], "block_id long, members array<long>"))
    hist = scorers.histograms(sites.pattern_counts(q, spark.createDataFrame(s)))
    assert abs(sum(hist.first()["hist"]) - 1) < 1e-9
    a = scorers.mlp_scores(hist, w).toPandas()
    b = scorers.transformer_scores(q.join(hist, list(sites.Q)), w, heads=4).toPandas()
    assert np.allclose(a[["w0", "w1", "w2"]].sum(1), 100) and np.allclose(b[["w0", "w1", "w2"]].sum(1), 100) and len(a) == len(b) == 15


def test_one_hot(spark):
    q = spark.createDataFrame([(0, 3, 5, 23)], "q0 int, q1 int, q2 int, q3 int")
    hot = sites.one_hot(q).first()["hot"]
    assert [i for i, x in enumerate(hot) if x] == [0, 3, 5, 23] and len(hot) == 24


@pytest.mark.parametrize("mode", ["full", "batch_only", "off"])
def test_stream_modes(spark, tmp_path, mode):
    from quadrille.operators import splits
    from quadrille.streaming import aggregate

    rows = [(b, 0, 1, 2, 3, 10.0 * b, 5.0, 1.0) for b in range(1, 4)] + [(1, 0, 1, 2, 4, 50.0, 50.0, 0.0)]
    df = spark.createDataFrame(rows, aggregate.SCHEMA)
    for i in range(1, 4):
        df.filter(F.col("block_id") == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = aggregate.run(aggregate.read(spark, f"{tmp_path}/in"), mode, f"{tmp_path}/out", f"{tmp_path}/state")
    want = splits.to_splits(splits.aggregated(df, mode))
    assert sorted(map(tuple, got.select(*"abcdw").collect())) == sorted(map(tuple, want.collect()))


def test_stream_restarted(spark, tmp_path):
    """A batch fails, the run begins anew from its checkpoint, more files come: sums are those of all rows, and a batch writes no more than it has."""
    from quadrille.operators import splits
    from quadrille.streaming import aggregate

    rows = [(b, 0, 1, 2, 3 + b % 4, 10.0 * b, 5.0, 1.0) for b in range(8)] + [(b, 0, 1, 2, 9, 1.0, 2.0, 3.0) for b in range(8)]
    df = spark.createDataFrame(rows, aggregate.SCHEMA)
    one = lambda i: df.filter(F.col("block_id") == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for i in range(4):
        one(i)
    blocked = aggregate.splits.aggregated
    with pytest.raises(Exception, match="lost"):

        def failing(*args, **kw):
            return blocked(*args, **kw).withColumn("s0", F.when(F.col("q3") == 5, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("s0")))

        aggregate.splits.aggregated = failing
        try:
            aggregate.run(aggregate.read(spark, f"{tmp_path}/in"), "full", f"{tmp_path}/out", f"{tmp_path}/state")
        finally:
            aggregate.splits.aggregated = blocked
    for i in range(4, 8):
        one(i)
    got = aggregate.run(aggregate.read(spark, f"{tmp_path}/in"), "full", f"{tmp_path}/out", f"{tmp_path}/state")
    want = splits.to_splits(splits.aggregated(df, "full"))
    assert sorted(map(tuple, got.select(*"abcdw").collect())) == sorted(map(tuple, want.collect()))
    assert all(r["count"] <= 2 for r in spark.read.parquet(f"{tmp_path}/out").groupBy("batch").count().collect())
