"""Hard negatives: what is written and what meets in one call, as anchors and rows grow."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from quadrille.llm import negatives


def test_no_scores_are_kept(spark, monkeypatch):
    """Tables written hold the rows and the result; scores are anchors times rows."""
    sizes = {}

    def written(df, name, f=negatives.written):
        out = f(df, name)
        blobs = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in out.dtypes if kind == "binary"]
        sizes[name] = sizes.get(name, 0) + (out.agg(F.sum(sum(blobs, F.lit(0)))).first()[0] or 0 if blobs else 0)
        return out

    monkeypatch.setattr(negatives, "written", written)
    rng = np.random.default_rng(4)
    n, anchors = 2000, 200
    rows = [(i, i % 3, [float(x) for x in rng.normal(size=8)]) for i in range(n)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    found = negatives.hard_negatives(df, F.col("id") < anchors).select("anchor_id").distinct().count()
    assert found > anchors // 2 and 0 < sum(sizes.values()) < anchors * n


def test_parts_are_small():
    """Strips cover a tile's anchors in order, in the fewest bits, and parts add up to the exact scores."""
    rng = np.random.default_rng(5)
    x, y = (rng.integers(-40, 41, size=(k, 5)) for k in (10, 7))
    y[:, 3:] *= 1 << 20
    a_ids, b_ids = np.arange(10), np.arange(7) + 3
    out = []
    for chunk, dims in enumerate((slice(0, 3), slice(3, 5))):
        lead = lambda v: negatives._bytes(v) if chunk == 0 else None  # noqa: B023, E731
        side = lambda s, block, v, part: pa.table({block: [0], f"{s}_n": [len(v)], f"{s}_ids": pa.array([lead(v)], pa.binary()), f"{s}_labels": pa.array([lead(v % 2)], pa.binary()), f"{s}_part": [negatives._bytes(part, np.int32)]})  # noqa: B023, E731
        out.append(negatives._multiplied(4)(side("a", "a_tile", a_ids, x[:, dims]), side("b", "b_shard", b_ids, y[:, dims])))
    assert max(len(s) for s in out[0].column("scores").to_pylist()) == 2 * 4 * 7
    parts, seen = pa.concat_tables(out), []
    for strip in range(3):
        (a, la, b, lb, scores), = negatives._added(parts.filter(pc.equal(parts.column("strip"), strip)))
        assert (la == a % 2).all() and (b == b_ids).all() and (lb == b % 2).all() and (scores == x[a] @ y.T).all()
        seen += a.tolist()
    assert seen == list(range(10))
