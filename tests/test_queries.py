"""Every registered query of the engine against its SQL twin."""

import duckdb
import pytest

from quadrille.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple("null" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_twin(spark, sf_dir, duck, name):
    assert rows(queries.FOUND[name](spark, sf_dir).toPandas()) == rows(duck.sql(queries.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.FOUND) - set(queries.SQL)))
def test_runs(spark, sf_dir, name):
    assert queries.FOUND[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["a", "b", "c", "d", "w"]


def test_block_design_holds_all_taxa(spark, sf_dir):
    import __spark_entry__

    import itertools
    from collections import Counter, defaultdict

    from quadrille.operators import design

    kinds = {f"{r['p_brand']}-{r['p_size']}" for r in spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand", "p_size").collect()}
    blocks = defaultdict(set)
    for r in __spark_entry__.queries()["block_design"](spark, sf_dir).collect():
        blocks[r["block_id"]].add(r["taxon"])
    assert set().union(*blocks.values()) == kinds and all(len(b) == 24 for b in blocks.values()) and len(blocks) == design.block_count(len(kinds), 2.5)
    pairs = Counter(p for b in blocks.values() for p in itertools.combinations(sorted(b), 2))
    assert max(pairs.values()) - min(pairs.get(p, 0) for p in itertools.combinations(sorted(kinds), 2)) <= 5


@pytest.mark.parametrize("method", ["qfm", "qmc"])
@pytest.mark.parametrize("local", [1 << 18, 200])
def test_assembly_recovers_caterpillar(spark, sf_dir, method, local):
    """A tenth of the splits is wrong; the tree is that of the others, in one task or level by level."""
    from quadrille.operators import trees
    from quadrille.plans.assemble import assemble
    from quadrille.plans.infer import _table
    from quadrille.plans.relations import supplier_splits

    found = supplier_splits(spark, sf_dir)
    taxa = sorted({t for r in found.collect() for t in tuple(r)[:4]})
    got = trees.rf(_table(spark, assemble(found, method, local=local)), _table(spark, queries._fixed_tree(taxa))).first()
    assert len(taxa) > 5 and got["rf"] <= (0 if method == "qfm" else 0.35)


@pytest.mark.parametrize("method", ["qfm", "qmc"])
def test_fixed_tree_from_its_quartets(spark, method):
    """All quartets of a caterpillar of ten taxa, through both assemblers and all norms."""
    import itertools

    from quadrille.operators import trees
    from quadrille.plans.assemble import assemble
    from quadrille.plans.infer import _table

    rows = spark.createDataFrame([(*q, 5) for q in itertools.combinations(range(10), 4)], "a long, b long, c long, d long, w long")
    for norm in ("n0", "n1", "n2"):
        assert trees.rf(_table(spark, assemble(rows, method, norm)), _table(spark, queries._fixed_tree(list(range(10))))).first()["rf"] == 0
    with pytest.raises(ValueError, match="norm"):
        assemble(rows, method, "n3")


def test_infer_tree_holds_all_labels(spark, sf_dir):
    leaves = {r["name"] for r in queries.FOUND["infer_tree"](spark, sf_dir).filter("is_leaf").collect()}
    labels = {r["taxon"] for r in __import__("quadrille.plans.fixtures", fromlist=["x"]).label_sites(spark, sf_dir).select("taxon").distinct().collect()}
    assert leaves == {f"label{t}" for t in labels}
