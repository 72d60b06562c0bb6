"""Site patterns from distinct columns."""

import itertools
import re

import numpy as np
import pandas as pd
import pytest

from quadrille.operators import sites


def alignment(taxa, length, seed):
    """Rows of a made-up alignment with gaps and without some rows; taxa have any numbers."""
    rng = np.random.default_rng(seed)
    rows = pd.DataFrame([(int(t), p, int(rng.choice(5, p=[0.4, 0.3, 0.15, 0.1, 0.05]))) for t in taxa for p in range(length)], columns=["taxon", "pos", "state"])
    return rows[rng.random(len(rows)) < 0.95]


def counted(rows, quartets):
    at = {(t, p): s for t, p, s in rows.itertuples(index=False) if s < 4}
    out = {}
    for q in quartets:
        for p in rows.pos.unique():
            s = [at.get((t, p)) for t in q]
            if None not in s:
                key = (*q, 64 * s[0] + 16 * s[1] + 4 * s[2] + s[3])
                out[key] = out.get(key, 0) + 1
    return out


@pytest.mark.parametrize("tile", [1 << 14, 3])
def test_patterns_of_more_taxa_than_a_word(spark, monkeypatch, tile):
    """Few quartets, which are broadcast, and more."""
    monkeypatch.setattr(sites, "TILE", tile)
    taxa = [k * 3 - 20 for k in range(45)]
    rows = alignment(taxa, 60, 0)
    quartets = [*itertools.combinations(taxa[:5], 4), (taxa[0], taxa[20], taxa[21], taxa[44]), (taxa[1], taxa[22], taxa[41], taxa[43]), (taxa[2], taxa[3], taxa[4], 999)]
    got = sites.site_patterns(spark.createDataFrame(quartets, "q0 long, q1 long, q2 long, q3 long"), spark.createDataFrame(rows)).toPandas()
    want = counted(rows, quartets)
    assert {(r.q0, r.q1, r.q2, r.q3, r.pat): r.n for r in got.itertuples()} == want and len(got) == len(want)
    assert np.allclose(got.groupby(["q0", "q1", "q2", "q3"]).freq.sum(), 1)


def test_no_row_of_a_quartet_and_a_position_is_shuffled(spark):
    known = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = sites.site_patterns(spark.createDataFrame([(0, 1, 2, 3)], "q0 long, q1 long, q2 long, q3 long"), spark.createDataFrame(alignment(range(4), 10, 1)))
        keys = re.findall(r"hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known)
    assert keys and not [k for k in keys if re.search(r"\bq\d#", k) and re.search(r"\b_?p(os|\d)#", k)]
