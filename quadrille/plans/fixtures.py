"""Relations that the registered queries derive from whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import sites
from .infer import block_weights


#: Ids of vectors that are numbered in one task.
RUN = 1 << 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def label_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(taxon, pos, state): each label of `embeddings` is a taxon; its vectors in order of id, component by component, are its sequence.

    States cut the components at 0 and +-0.1; what is within 0.005 of 0 is a gap.
    """
    e = table(spark, sf_dir, "embeddings").withColumn("run", F.floor(F.col("vec_id") / RUN))
    # A label's vectors are numbered run by run, and runs by the sizes of those before.
    before = Window.partitionBy("label").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = e.groupBy("label", "run").count().select("label", "run", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    k = F.row_number().over(Window.partitionBy("label", "run").orderBy("vec_id")) - 1
    numbered = e.withColumn("k", k).join(starts, ["label", "run"])
    rows = numbered.select(F.col("label").cast("long").alias("taxon"), (F.col("before") + F.col("k")).alias("k"), F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    state = F.when(F.abs("x") < 0.005, 4).when(F.col("x") < -0.1, 0).when(F.col("x") < 0, 1).when(F.col("x") < 0.1, 2).otherwise(3)
    return rows.select("taxon", (F.col("k") * 64 + F.col("i")).cast("long").alias("pos"), state.alias("state"))


#: The same in DuckDB.
LABEL_SITES = """
label_sites AS (
  SELECT CAST(label AS BIGINT) AS taxon, CAST(k * 64 + i AS BIGINT) AS pos,
    CASE WHEN abs(x) < 0.005 THEN 4 WHEN x < -0.1 THEN 0 WHEN x < 0 THEN 1 WHEN x < 0.1 THEN 2 ELSE 3 END AS state
  FROM (SELECT label, k, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x
        FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k FROM embeddings))
)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(block_id, members): block k has all labels but the two from k on, so blocks overlap widely."""
    taxa = table(spark, sf_dir, "embeddings").agg(F.array_sort(F.collect_set(F.col("label").cast("long"))).alias("all"))
    return taxa.select(F.explode("all").alias("block_id"), "all").select("block_id", F.array_except("all", F.array("block_id", F.col("block_id") + 1)).alias("members"))


BLOCKS = """
taxa AS (SELECT DISTINCT CAST(label AS BIGINT) AS taxon FROM embeddings),
blocks AS (SELECT k.taxon AS block_id, t.taxon FROM taxa k, taxa t WHERE t.taxon NOT IN (k.taxon, k.taxon + 1)),
block_quartets AS (
  SELECT a.block_id, a.taxon AS q0, b.taxon AS q1, c.taxon AS q2, d.taxon AS q3 FROM blocks a
  JOIN blocks b ON a.block_id = b.block_id AND a.taxon < b.taxon JOIN blocks c ON b.block_id = c.block_id AND b.taxon < c.taxon
  JOIN blocks d ON c.block_id = d.block_id AND c.taxon < d.taxon
)"""


def weights(spark: SparkSession, sf_dir: str, kernel: bool = True) -> DataFrame:
    """(block_id, q0..q3, w0..w2) of the blocks over the informative label sites."""
    rows = sites.informative(label_sites(spark, sf_dir))
    return block_weights(blocks(spark, sf_dir), rows, kernel)


WEIGHTS = (
    LABEL_SITES
    + """,
kept AS (SELECT pos FROM label_sites GROUP BY pos HAVING min(state) < max(state)),
inf AS (SELECT taxon, CAST(dense_rank() OVER (ORDER BY pos) - 1 AS BIGINT) AS pos, state FROM label_sites JOIN kept USING (pos)),"""
    + BLOCKS
    + """,
distinct_q AS (SELECT DISTINCT q0, q1, q2, q3 FROM block_quartets),
base AS (SELECT * FROM inf WHERE state < 4),
patterns AS (
  SELECT q0, q1, q2, q3, CAST(64 * a.state + 16 * b.state + 4 * c.state + d.state AS INTEGER) AS pat, count(*) AS n
  FROM distinct_q JOIN base a ON a.taxon = q0 JOIN base b ON b.taxon = q1 AND b.pos = a.pos
  JOIN base c ON c.taxon = q2 AND c.pos = a.pos JOIN base d ON d.taxon = q3 AND d.pos = a.pos GROUP BY ALL
),
s AS (SELECT *, pat // 64 % 4 AS s0, pat // 16 % 4 AS s1, pat // 4 % 4 AS s2, pat % 4 AS s3 FROM patterns),
counts AS (
  SELECT q0, q1, q2, q3, CAST(coalesce(sum(n) FILTER (s0 = s1 AND s2 = s3 AND s0 <> s2), 0) AS BIGINT) AS c0,
    CAST(coalesce(sum(n) FILTER (s0 = s2 AND s1 = s3 AND s0 <> s1), 0) AS BIGINT) AS c1, CAST(coalesce(sum(n) FILTER (s0 = s3 AND s1 = s2 AND s0 <> s1), 0) AS BIGINT) AS c2
  FROM s GROUP BY ALL
),
scores AS (SELECT q0, q1, q2, q3, 100.0::DOUBLE * (c0 + 1) / (c0 + c1 + c2 + 3) AS w0, 100.0::DOUBLE * (c1 + 1) / (c0 + c1 + c2 + 3) AS w1, 100.0::DOUBLE * (c2 + 1) / (c0 + c1 + c2 + 3) AS w2
  FROM distinct_q LEFT JOIN counts USING (q0, q1, q2, q3)),
weights AS (SELECT block_id, q.q0, q.q1, q.q2, q.q3, w0, w1, w2 FROM block_quartets q JOIN scores USING (q0, q1, q2, q3))"""
)


def splits_sql(source: str, by: str = "q0, q1, q2, q3") -> str:
    """Splits of weights in DuckDB, as a WITH item `splits`."""
    agg = f"SELECT q0, q1, q2, q3, sum(w0) AS s0, sum(w1) AS s1, sum(w2) AS s2, count(*) AS n FROM {source} GROUP BY {by}"
    if not by:
        agg = f"SELECT q0, q1, q2, q3, w0 AS s0, w1 AS s1, w2 AS s2, 1 AS n FROM {source}"
    w = lambda k: f"CAST(round_even(round(CAST(s{k} / n AS DOUBLE), 9), 0) AS BIGINT)"
    return f"""agg AS ({agg}), splits AS (SELECT * FROM (
  SELECT q0 AS a, q1 AS b, q2 AS c, q3 AS d, {w(0)} AS w FROM agg UNION ALL SELECT q0, q2, q1, q3, {w(1)} FROM agg UNION ALL SELECT q0, q3, q1, q2, {w(2)} FROM agg) WHERE w > 0)"""


def geo_tree(spark: SparkSession, sf_dir: str, moved: bool = False) -> DataFrame:
    """Regions, nations and customers as a tree; moved puts nation 0 under region 4."""
    region, nation, customer = (table(spark, sf_dir, n) for n in ("region", "nation", "customer"))
    key = F.when(F.col("n_nationkey") == 0, F.lit(4)).otherwise(F.col("n_regionkey")) if moved else F.col("n_regionkey")
    schema = ("node_id", "parent_id", "name", "is_leaf")
    root = spark.range(1).select(F.lit("root"), F.lit(None).cast("string"), F.lit("root"), F.lit(False)).toDF(*schema)
    regions = region.select(F.concat(F.lit("r"), "r_regionkey"), F.lit("root"), "r_name", F.lit(False)).toDF(*schema)
    nations = nation.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), key), "n_name", F.lit(False)).toDF(*schema)
    leaves = customer.select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), "c_name", F.lit(True)).toDF(*schema)
    return root.union(regions).union(nations).union(leaves)


def geo_sql(name: str, moved: bool = False) -> str:
    key = "CASE WHEN n_nationkey = 0 THEN 4 ELSE n_regionkey END" if moved else "n_regionkey"
    return f"""{name} AS (
  SELECT 'root' AS node_id, CAST(NULL AS VARCHAR) AS parent_id, 'root' AS name, false AS is_leaf
  UNION ALL SELECT 'r' || r_regionkey, 'root', r_name, false FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || ({key}), n_name, false FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name, true FROM customer)"""


def event_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, taxon, state): twelve groups of users are taxa, days of the month characters; the state is the first letter of the last event's type, - without one."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 12).alias("taxon"), F.dayofmonth("ts").alias("pos"), "event_id", "event_type")
    last = e.groupBy("taxon", "pos").agg(F.substring(F.max_by("event_type", "event_id"), 1, 1).alias("state"))
    grid = e.select("taxon").distinct().join(e.select("pos").distinct())
    return grid.join(last, ["taxon", "pos"], "left").select(F.col("pos").cast("long").alias("pos"), F.col("taxon").cast("long").alias("taxon"), F.coalesce("state", F.lit("-")).alias("state"))


EVENT_CHARACTERS = """
ev AS (SELECT user_id % 12 AS taxon, day(ts) AS pos, event_id, event_type FROM events),
chars AS (
  SELECT CAST(p.pos AS BIGINT) AS pos, CAST(t.taxon AS BIGINT) AS taxon, coalesce(l.state, '-') AS state
  FROM (SELECT DISTINCT taxon FROM ev) t CROSS JOIN (SELECT DISTINCT pos FROM ev) p
  LEFT JOIN (SELECT taxon, pos, left(max_by(event_type, event_id), 1) AS state FROM ev GROUP BY ALL) l ON l.taxon = t.taxon AND l.pos = p.pos
)"""
