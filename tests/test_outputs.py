"""Annotated trees, sinks, evaluation, tiled attention."""

import itertools

import numpy as np
import pytest

from quadrille.operators import scorers, support, trees
from quadrille.plans import evaluate, newick
from quadrille.plans.infer import _table
from quadrille.sources import sinks
from quadrille.sources.quartets import Config


def test_annotations_round_trip(spark):
    tree = newick.parse("((a,b),(c,(d,e)));")
    table = _table(spark, tree)
    quads = support.quadripartitions(table)
    q = trees.gene_tree_quartets(spark.createDataFrame([(1, "((a,b),(c,(d,e)));"), (2, "((a,c),(b,(d,e)));")], "tree_id long, newick string"))
    rows = [r.asDict() for r in support.support(support.gene_tree_frequencies(q, table)).collect()]
    marked = newick.annotated(tree, rows)
    again = newick.parse(newick.write(marked, info=True))
    got = {newick.known(x)["q1"] for x in again.walk() if x.info}
    assert got == {f"{r['q1']:.6f}" for r in rows} and len(rows) == 2 and newick.rf_distance(again, tree) == 0
    assert newick.write(again, info=True) == newick.write(marked, info=True)
    p = newick.with_p_values(tree, [{"branch": rows[0]["branch"], "p_tree": 0.5, "p_star": 1e-9, "n0": 3, "n1": 2, "n2": 1}], {rows[0]["branch"]: 4})
    (known,) = [newick.known(x) for x in newick.parse(newick.write(p, info=True)).walk() if x.info]
    assert known == {"blob_id": "4", "qtt_p": "5.000000000000e-01", "qst_p": "1.000000000000e-09", "qcf_1": "3", "qcf_2": "2", "qcf_3": "1"}


def test_forms_of_newick():
    tree = newick.parse("((a:1,b:2)0.25:1,(c:1,d:1)x:3)0.5;")
    assert newick.support_only(tree) == "((a,b)0.250000,(c,d));"
    assert newick.indexed(tree, dict(zip("abcd", range(4)))) == "((0,1),(2,3));"
    assert newick.marked(newick.parse("((a,b)PCS,(c,d));")).children[0].name == "a"
    with pytest.raises(ValueError, match="0 nodes"):
        newick.marked(tree)
    assert newick.parse("[&R]((a,b)[k=1;j=x]0.5,c);").children[0].info == "k=1;j=x"


def test_prepared():
    tree = newick.parse("(((a,b)90:1,c)20:2,((d,e)101:1,f)100:1);")
    assert [x.support for x in newick.prepared(tree, 0, 100).walk() if x.children and x.parent] == [0.9, 0.2, 0.0, 1.0]
    assert newick.splits(newick.prepared(tree, 0, 100, threshold=0.5)) == newick.splits(newick.parse("((a,b),c,(d,e,f));"))
    assert newick.write(newick.prepared(tree, 0, 100, "n", 0.5)) == newick.write(tree)


def test_support_and_partition_files(spark, tmp_path):
    tree = "((a,b),(c,(d,e)));"
    table = _table(spark, newick.parse(tree))
    quads = support.quadripartitions(table)
    q = trees.gene_tree_quartets(spark.createDataFrame([(i, tree) for i in range(12)], "tree_id long, newick string"))
    rows = support.support_table(support.support(support.gene_tree_frequencies(q, table)))
    sinks.write_support(rows, f"{tmp_path}/s")
    back = spark.read.csv(f"{tmp_path}/s", sep="\t", header=True, inferSchema=True, nullValue="NA")
    assert back.columns == ["node", "tree", "qfreq", "en", "qsupp", "brlen"] and back.count() == 6 and back.filter("brlen is null").count() == 4
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        sinks.write_support(rows, f"{tmp_path}/s")
    branch = quads.agg({"branch": "min"}).first()[0]
    lines = sinks.partitioned_lines(support.partitioned_support(q, table, branch), quads, branch)
    for mode in ("errorifexists", "overwrite"):
        sinks.write_lines(lines, f"{tmp_path}/p", mode)
    text = [x for f in sorted((tmp_path / "p").glob("part-*")) for x in f.read_text().splitlines()]
    assert [x[:4] for x in text[:4]] == ["# x ", "# y ", "# z ", "# w "] and text[4].split("\t")[0] == "tree_id" and [x.split("\t")[0] for x in text[5:]] == [str(i) for i in range(12)]


def test_subproblems_and_paths(spark, tmp_path):
    rows = sinks.subproblems(spark, [{"id": 0, "parent": None, "depth": 0, "size": 4, "artificial": 0, "subset": ["a", "b", "c", "d"]}]).collect()
    assert rows[0].asDict() == {"ID": 0, "PARENT": None, "DEPTH": 0, "SIZE": 4, "ARTIFICIAL": 0, "SUBSET": "a;b;c;d"}
    assert sinks.output_path(f"{tmp_path}", "/x/data.phy") == f"{tmp_path}/data.nwk"
    made = sinks.output_path(f"{tmp_path}/new/deep", "data.phy")
    assert made == f"{tmp_path}/new/deep/data.nwk" and (tmp_path / "new" / "deep").is_dir()
    (tmp_path / "t.nwk").write_text("x")
    assert sinks.output_path(f"{tmp_path}/t.nwk", "data.phy") == f"{tmp_path}/t.nwk"
    with pytest.raises(FileExistsError):
        sinks.output_path(f"{tmp_path}/t.nwk", "data.phy", overwrite=False)


def test_evaluation():
    rng = np.random.default_rng(1)
    one = newick.random_tree([f"t{i}" for i in range(12)], rng)
    two = newick.random_tree([f"t{i}" for i in range(3, 14)], rng)
    names = sorted({f"t{i}" for i in range(3, 12)})
    own, other = evaluate.common(one, two)
    shown = [{frozenset([frozenset(q[:2]), frozenset(q[2:4])]) for q in newick.all_quartets(t)} for t in (own, other)]
    got = evaluate.quartet_concordance(one, two)
    resolved = len(shown[0] & shown[1])
    assert got["evaluated"] == len(list(itertools.combinations(names, 4))) and got["matches"] == resolved and len(got["mismatches"]) == 3
    assert evaluate.quartet_concordance(one, two, 50) == evaluate.quartet_concordance(one, two, 50) and evaluate.quartet_concordance(one, two, 50)["evaluated"] == 50
    assert evaluate.evaluated(one, one) == {"rf": 0.0} and evaluate.evaluated(one, two)["rf"] == newick.rf_distance(own, other)
    assert evaluate.evaluated(one, one, Config(metric="quartet"))["concordance"] == 1
    wide = newick.random_tree([f"t{i}" for i in range(100)], rng)
    assert evaluate.quartet_concordance(wide, wide)["evaluated"] == 10_000
    assert evaluate.quartet_concordance(one, newick.parse("(x,y,z);"))["concordance"] is None


@pytest.mark.parametrize("sample", [0, -1, None, 50])
def test_evaluation_on_executors(spark, sample):
    rng = np.random.default_rng(2)
    one, two = (newick.random_tree([f"t{i}" for i in range(14)], rng) for _ in range(2))
    want = evaluate.quartet_concordance(one, two, sample)
    assert evaluate.quartet_concordance(one, two, sample, spark=spark) == want and want["evaluated"] == (50 if sample == 50 else 1001)
    assert evaluate.evaluated(one, two, Config(metric="quartet", quartet_sample_size=sample or 0), spark)["evaluated"] == want["evaluated"]


def test_sample_of_a_wide_tree(spark):
    rng = np.random.default_rng(3)
    one = newick.random_tree([f"t{i}" for i in range(1024)], rng)
    two = newick.random_tree([f"t{i}" for i in range(1024)], rng)
    got = evaluate.quartet_concordance(one, two, 40_000, spark=spark)
    assert got == evaluate.quartet_concordance(one, two, 40_000) and got["evaluated"] == 40_000 and 0.25 < got["concordance"] < 0.45
    assert evaluate.quartet_concordance(one, one, 0, spark=spark)["concordance"] == 1 and evaluate.quartet_concordance(one, one, 0)["evaluated"] == 10_000


def test_tiled_attention_is_that_over_all_pairs():
    rng = np.random.default_rng(3)
    q = np.array(list(itertools.combinations(range(11), 4)))[rng.permutation(330)[:201]]
    x, heads = rng.normal(size=(len(q), 24)), 4
    w = {f"p.{n}.{k}": rng.normal(size=(24, 24) if k == "w" else 24) for n in "qkvo" for k in "wb"}
    mask = ((q[:, None, :, None] == q[None, :, None, :]).sum((2, 3)) >= 3) | np.eye(len(q), dtype=bool)
    a, b, c = (x @ w[f"p.{n}.w"] + w[f"p.{n}.b"] for n in "qkv")
    want = np.hstack([scorers.softmax(np.where(mask, a[:, s] @ b[:, s].T / np.sqrt(6), -np.inf)) @ c[:, s] for s in (slice(h * 6, h * 6 + 6) for h in range(heads))]) @ w["p.o.w"] + w["p.o.b"]
    for tile in (7, 64, 500):
        assert np.allclose(scorers.attention(x, scorers.shared_tiles(q, tile=tile), w, "p", heads), want)
    with pytest.raises(ValueError, match="64"):
        scorers.shared_tiles(np.arange(68).reshape(17, 4))
