"""Queries of single functions over whole tables, beside those of queries.py, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import characters, genetrees, graph, sites, splits, support, trees
from ..sources import alignments, quartets
from ..sources.tables import shared_dir, written
from ..streaming import aggregate
from . import fixtures
from .assemble import assemble, assemble_gene_trees
from .infer import _table
from .queries import CLASSES, GRAPH, GROUPS, WITH_SPLITS, _fixed_tree, _label_tree, _splits, _two_trees, query

FOUR = ("a", "b", "c", "d")


@query(
    """WITH k AS (SELECT l_orderkey % 32768 AS a, l_partkey % 65536 AS b, l_suppkey % 65536 AS c, l_linenumber AS d FROM lineitem)
SELECT CAST(a * 281474976710656 + b * 4294967296 + c * 65536 + d AS BIGINT) AS k, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, CAST(c AS INTEGER) AS c, CAST(d AS INTEGER) AS d FROM k"""
)
def quartet_keys(spark, sf_dir):
    """Four ids as one key, and back."""
    rows = fixtures.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 32768).alias("a"), (F.col("l_partkey") % 65536).alias("b"), (F.col("l_suppkey") % 65536).alias("c"), F.col("l_linenumber").alias("d"))
    keyed = rows.select(scalar.key(*map(F.col, FOUR)).alias("k"))
    return keyed.select("k", *(c.alias(x) for x, c in zip(FOUR, scalar.unkey(F.col("k")))))


SCORED = """s AS (SELECT l_orderkey, l_linenumber, CAST(l_discount * 30 AS DOUBLE) AS x0, CAST(l_tax * 40 AS DOUBLE) AS x1, CAST(l_quantity / 25 AS DOUBLE) AS x2 FROM lineitem)"""


def _scored(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 30).cast("double").alias("x0"), (F.col("l_tax") * 40).cast("double").alias("x1"), (F.col("l_quantity") / 25).cast("double").alias("x2"))


@query(f"WITH {SCORED}, e AS (SELECT *, exp(x0) + exp(x1) + exp(x2) AS t FROM s) SELECT l_orderkey, l_linenumber, round(100 * exp(x0) / t, 6) AS w0, round(100 * exp(x1) / t, 6) AS w1, round(100 * exp(x2) / t, 6) AS w2 FROM e")
def softmax_weights(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    return rows.select("l_orderkey", "l_linenumber", *(F.round(w, 6).alias(f"w{k}") for k, w in enumerate(scalar.softmax100(*(F.col(f"x{k}") for k in range(3))))))


@query(
    f"""WITH {SCORED}, g AS (SELECT l_orderkey, l_linenumber, x0 / 4 AS x0, x1 / 4 AS x1, x2 / 4 AS x2, greatest(x0, x1, x2) / 4 AS top FROM s),
b AS (SELECT *, CASE WHEN x0 = top THEN 0 WHEN x1 = top THEN 1 ELSE 2 END AS best, greatest(round_even(x0, 0), round_even(x1, 0), round_even(x2, 0)) < 1 AS low FROM g)
SELECT l_orderkey, l_linenumber, CASE WHEN low THEN CAST(best = 0 AS BIGINT) ELSE CAST(round_even(x0, 0) AS BIGINT) END AS w0,
  CASE WHEN low THEN CAST(best = 1 AS BIGINT) ELSE CAST(round_even(x1, 0) AS BIGINT) END AS w1, CASE WHEN low THEN CAST(best = 2 AS BIGINT) ELSE CAST(round_even(x2, 0) AS BIGINT) END AS w2 FROM b"""
)
def guarded_weights(spark, sf_dir):
    """Rounded weights, of which one is 1 at least."""
    rows = _scored(spark, sf_dir)
    return rows.select("l_orderkey", "l_linenumber", *(w.alias(f"w{k}") for k, w in enumerate(scalar.guarded(*(F.col(f"x{k}") / 4 for k in range(3))))))


@query("SELECT c_custkey, 't' || c_custkey AS label FROM customer")
def taxon_labels(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "customer").select("c_custkey", scalar.label(F.col("c_custkey")).alias("label"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST('0.' || o_custkey AS DOUBLE) WHEN 1 THEN CAST(o_custkey || 'e-3' AS DOUBLE) END AS q1,
CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS p FROM orders"""
)
def node_annotations(spark, sf_dir):
    """Supports from node names, and a value from a node's annotations."""
    k = F.col("o_custkey").cast("string")
    name = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("n_q1_0."), k)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("q1="), k, F.lit("e-3"))).otherwise(F.concat(F.lit("n"), k))
    info = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("[blob_id=1;qtt_p="), "o_orderpriority", F.lit(";x=2]"))).otherwise(F.lit("[blob_id=1]"))
    return fixtures.table(spark, sf_dir, "orders").select("o_orderkey", scalar.q1_support(name).alias("q1"), scalar.branch_info(info, "qtt_p").alias("p"))


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_partkey AS DOUBLE) / 10 END AS number, CASE l_returnflag WHEN 'N' THEN 'false' END AS flag FROM lineitem"""
)
def parsed_options(spark, sf_dir):
    """Numbers and booleans in text, null where the text is neither."""
    text = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" "), (F.col("l_partkey") / 10).cast("string"), F.lit(" "))).otherwise(F.col("l_returnflag"))
    return fixtures.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalar.number(text).alias("number"), scalar.flag(F.col("l_returnflag")).cast("string").alias("flag"))


@query(
    """WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_quantity AS DOUBLE) END AS s, CAST(l_discount AS DOUBLE) * 10 AS len FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE WHEN s BETWEEN 10 AND 40 THEN (s - 10) / 30 ELSE 0 END, 9) AS support, round(exp(-len), 9) AS weight,
  CASE WHEN len <= 1 / 3 THEN 0.0::DOUBLE WHEN len >= 1 THEN 9.0::DOUBLE ELSE round(-ln(1.5 * (1 - len)), 9) END AS brlen FROM s"""
)
def support_scales(spark, sf_dir):
    """Rescaled supports, length weights and coalescent lengths."""
    rows = fixtures.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 7, F.col("l_quantity").cast("double")).alias("s"), (F.col("l_discount").cast("double") * 10).alias("len"))
    return rows.select("l_orderkey", "l_linenumber", F.round(scalar.support01(F.col("s"), 10, 40), 9).alias("support"), F.round(scalar.length_weight(F.col("len"), "h"), 9).alias("weight"), F.round(scalar.coalescent_length(F.col("len")), 9).alias("brlen"))


@query(f"WITH {fixtures.BLOCKS}, q AS (SELECT DISTINCT q0, q1, q2, q3 FROM block_quartets) SELECT *, array_to_string([CASE WHEN i IN (q0, q1, q2, q3) THEN '1' ELSE '0' END FOR i IN range(24)], '') AS hot FROM q")
def one_hot_quartets(spark, sf_dir):
    q = sites.block_quartets(fixtures.blocks(spark, sf_dir)).select(*sites.Q).distinct()
    return sites.one_hot(q).withColumn("hot", F.array_join(F.col("hot").cast("array<string>"), ""))


@query(
    """WITH c AS (SELECT c_custkey, upper(c_name) AS n FROM customer)
SELECT c_custkey, array_to_string([CASE ch WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 4 END FOR ch IN string_split(n, '')], '') AS states, CAST((length(n) + 1) // 2 AS INTEGER) AS bytes FROM c"""
)
def packed_states(spark, sf_dir):
    """Sequences packed two states to a byte, and read back."""
    rows = fixtures.table(spark, sf_dir, "customer").select("c_custkey", scalar.states(F.col("c_name")).alias("s"))
    blob = rows.select("c_custkey", F.size("s").alias("n"), alignments.packed(F.col("s")).alias("data"))
    return blob.select("c_custkey", F.array_join(alignments.unpacked(F.col("data"), F.col("n")).cast("array<string>"), "").alias("states"), F.octet_length("data").alias("bytes"))


@query(
    """WITH p AS (SELECT DISTINCT c_nationkey AS part FROM customer), t AS (SELECT DISTINCT c_mktsegment AS taxon FROM customer),
s AS (SELECT c_nationkey AS part, c_mktsegment AS taxon, lpad(CAST(count(*) AS VARCHAR), 6, 'A') AS seq FROM customer GROUP BY ALL)
SELECT taxon, string_agg(coalesce(seq, '------'), '' ORDER BY part) AS seq FROM p CROSS JOIN t LEFT JOIN s USING (part, taxon) GROUP BY taxon"""
)
def supermatrix(spark, sf_dir):
    """Alignments of nations, of which a segment of customers may lack some, end to end."""
    rows = fixtures.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("part"), F.col("c_mktsegment").alias("taxon")).count()
    return alignments.supermatrix(rows.select("part", "taxon", F.lpad(F.col("count").cast("string"), 6, "A").alias("seq")))


QUARTERS = """t AS (SELECT l_orderkey AS k, 'u' || l_partkey % 7 AS t1, 'v' || l_suppkey % 5 AS t2, 'b' || l_linenumber % 4 AS t3, 'w' || l_orderkey % 3 AS t4, CAST(l_quantity AS DOUBLE) AS w FROM lineitem)"""


def _quarters(spark, sf_dir):
    name = lambda x, c, n: F.concat(F.lit(x), (F.col(c) % n).cast("string"))
    names = (name("u", "l_partkey", 7), name("v", "l_suppkey", 5), name("b", "l_linenumber", 4), name("w", "l_orderkey", 3))
    return fixtures.table(spark, sf_dir, "lineitem").select(*(n.alias(f"t{k}") for k, n in enumerate(names, 1)), F.col("l_quantity").cast("double").alias("w"))


def _canonical_sql(source: str, agg: str) -> str:
    return f"""p AS (SELECT least(x, y) AS a, greatest(x, y) AS b, least(z, v) AS c, greatest(z, v) AS d, w FROM ({source})),
c AS (SELECT CASE WHEN a < c OR (a = c AND b <= d) THEN [a, b, c, d] ELSE [c, d, a, b] END AS s, w FROM p) SELECT s[1] AS a, s[2] AS b, s[3] AS c, s[4] AS d, {agg} FROM c GROUP BY ALL"""


@query(f"WITH {QUARTERS}, " + _canonical_sql("SELECT t1 AS x, t2 AS y, t3 AS z, t4 AS v, w FROM t", "round(sum(w), 6) AS w"))
def weighted_quartet_lines(spark, sf_dir):
    """Quartets with weights in lines of text, read by their template and summed."""
    lines = _quarters(spark, sf_dir).select(F.format_string("%s,%s|%s,%s:%s", "t1", "t2", "t3", "t4", F.col("w").cast("string")).alias("value"))
    return quartets.summed(quartets.parse_quartets(lines, quartets.QMC)).withColumn("w", F.round("w", 6))


@query(f"WITH {QUARTERS}, " + _canonical_sql("SELECT t4 AS x, t3 AS y, t2 AS z, t1 AS v, w FROM t", "count(*) AS freq"))
def bare_quartet_lines(spark, sf_dir):
    """Quartets without weights, several to a line, counted."""
    lines = _quarters(spark, sf_dir).select(F.format_string("%s,%s|%s,%s", "t4", "t3", "t2", "t1").alias("v")).groupBy(F.xxhash64("v") % 50).agg(F.array_join(F.collect_list("v"), " ").alias("value"))
    found = quartets.parse_quartets(lines.select("value"), quartets.BARE)
    return splits.frequency(found)


@query(
    f"WITH {QUARTERS}, g AS (SELECT t1, t2, t3, t4, count(*) AS n, sum(w) AS w FROM t GROUP BY ALL), "
    + _canonical_sql(
        "SELECT t1 AS x, t2 AS y, t3 AS z, t4 AS v, w / 1000 * n AS w FROM g UNION ALL SELECT t1, t3, t2, t4, 0.25::DOUBLE * n FROM g UNION ALL SELECT t1, t4, t2, t3, 0.125::DOUBLE * n FROM g",
        "round(sum(w), 6) AS w, count(*) > 1 AS repeated",
    )
)
def concordance_table(spark, sf_dir):
    """A table of concordance factors as weighted splits."""
    t = _quarters(spark, sf_dir).groupBy("t1", "t2", "t3", "t4").agg(F.count("*").cast("double").alias("ngenes"), (F.sum("w") / 1000).alias("CF12_34"))
    return quartets.concordance_splits(t.withColumn("CF13_24", F.lit(0.25)).withColumn("CF14_23", F.lit(0.125))).withColumn("w", F.round("w", 6))


@query("SELECT c_custkey, CASE WHEN c_nationkey < 10 THEN n_name ELSE c_name END AS name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def mapped_names(spark, sf_dir):
    """Individuals named by their taxon where a map has one."""
    c, n = fixtures.table(spark, sf_dir, "customer"), fixtures.table(spark, sf_dir, "nation")
    mapping = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).filter("n_nationkey < 10").select(F.col("c_name").alias("indiv"), F.col("n_name").alias("taxon"))
    return quartets.mapped(c.select("c_custkey", F.col("c_name").alias("name")), mapping)


@query(
    f"""WITH {QUARTERS} SELECT CAST(substr(t1, 2) AS INTEGER) AS q0, CAST(substr(t2, 2) AS INTEGER) AS q1, CAST(substr(t3, 2) AS INTEGER) AS q2, CAST(substr(t4, 2) AS INTEGER) AS q3, count(*) AS n FROM t GROUP BY ALL"""
)
def quartet_numbers(spark, sf_dir):
    """Quartets of names as quartets of the numbers in them."""
    rows = _quarters(spark, sf_dir).toDF("a", "b", "c", "d", "w")
    return quartets.quartet_ids(rows).groupBy("q0", "q1", "q2", "q3").agg(F.count("*").alias("n"))


@query(f"{WITH_SPLITS} SELECT * FROM splits ORDER BY w DESC, a, b, c, d LIMIT 25")
def heaviest_splits(spark, sf_dir):
    """The report of the 25 heaviest splits."""
    return splits.by_weight(_splits(spark, sf_dir)).limit(25)


@query(
    f"""WITH {fixtures.WEIGHTS}, g AS (SELECT q0, q1, q2, q3, w0 / 150 AS w0, w1 / 150 AS w1, w2 / 150 AS w2, greatest(w0, w1, w2) / 150 AS top FROM weights),
r AS (SELECT *, greatest(round_even(w0, 0), round_even(w1, 0), round_even(w2, 0)) < 1 AS low, CASE WHEN w0 = top THEN 0 WHEN w1 = top THEN 1 ELSE 2 END AS best FROM g),
x AS (SELECT q0 AS a, q1 AS b, q2 AS c, q3 AS d, CASE WHEN low THEN CAST(best = 0 AS BIGINT) ELSE CAST(round_even(w0, 0) AS BIGINT) END AS w FROM r
  UNION ALL SELECT q0, q2, q1, q3, CASE WHEN low THEN CAST(best = 1 AS BIGINT) ELSE CAST(round_even(w1, 0) AS BIGINT) END FROM r
  UNION ALL SELECT q0, q3, q1, q2, CASE WHEN low THEN CAST(best = 2 AS BIGINT) ELSE CAST(round_even(w2, 0) AS BIGINT) END FROM r)
SELECT * FROM x WHERE w > 0"""
)
def repair_splits(spark, sf_dir):
    """Splits of a repair step: weights so low that rounding would leave none."""
    return splits.repair_splits(fixtures.weights(spark, sf_dir).select(*sites.Q, *((F.col(w) / 150).alias(w) for w in splits.W)))


@query(f"WITH {fixtures.WEIGHTS} SELECT q0, q1, q2, q3, round(sum(w0), 6) AS s0, round(sum(w1), 6) AS s1, round(sum(w2), 6) AS s2, count(*) AS n FROM weights GROUP BY ALL")
def merged_partials(spark, sf_dir):
    """Sums of each block's aggregates are those of all."""
    parts = splits.aggregated(fixtures.weights(spark, sf_dir), "batch_only")
    return splits.merged(parts).select(*sites.Q, *(F.round(f"s{k}", 6).alias(f"s{k}") for k in range(3)), "n")


@query(f"{WITH_SPLITS}{GRAPH} SELECT i, j, round(bad / (SELECT min(bad) FROM graph WHERE bad > 1), 9) AS w FROM graph")
def bad_edges(spark, sf_dir):
    return graph.edge_matrix(written(graph.quartet_graph(_splits(spark, sf_dir)), "graph"), "bad").withColumn("w", F.round("w", 9))


#: Resolved quartets of trees of which each inner node but the root is a group of characters.
CHARACTER_QUARTETS = """, k AS (SELECT DISTINCT pos, CAST(taxon AS VARCHAR) AS taxon, state FROM chars WHERE state NOT IN ('?', '-', 'N') AND pos IN (SELECT pos FROM good)),
m AS (SELECT a.pos, a.taxon AS q0, b.taxon AS q1, c.taxon AS q2, d.taxon AS q3, a.state AS s, b.state AS t, c.state AS u, d.state AS v
  FROM k a JOIN k b ON a.pos = b.pos AND a.taxon < b.taxon JOIN k c ON a.pos = c.pos AND b.taxon < c.taxon JOIN k d ON a.pos = d.pos AND c.taxon < d.taxon),
r AS (SELECT *, (s = t AND u <> s AND v <> s) OR (u = v AND s <> u AND t <> u) AS x0, (s = u AND t <> s AND v <> s) OR (t = v AND s <> t AND u <> t) AS x1, (s = v AND t <> s AND u <> s) OR (t = u AND s <> t AND v <> t) AS x2 FROM m)"""


@query(f"WITH {fixtures.EVENT_CHARACTERS}{GROUPS}{CHARACTER_QUARTETS} SELECT q0, q1, q2, q3, count(*) FILTER (x0) AS n0, count(*) FILTER (x1) AS n1, count(*) FILTER (x2) AS n2 FROM r WHERE x0 OR x1 OR x2 GROUP BY ALL")
def gene_tree_factors(spark, sf_dir):
    """Concordance factors of the characters as trees."""
    t = characters.newicks(characters.groups(fixtures.event_characters(spark, sf_dir)))
    return trees.concordance_factors(trees.gene_tree_quartets(t))


@query(
    f"""WITH {fixtures.EVENT_CHARACTERS}{GROUPS}{CHARACTER_QUARTETS}, e AS (SELECT pos, q0, q1, q2, q3, CASE WHEN x0 THEN 0 WHEN x1 THEN 1 ELSE 2 END AS cls FROM r WHERE x0 OR x1 OR x2),
s AS (SELECT pos, q0 AS a, CASE cls WHEN 0 THEN q1 WHEN 1 THEN q2 ELSE q3 END AS b, CASE cls WHEN 0 THEN q2 ELSE q1 END AS c, CASE cls WHEN 2 THEN q2 ELSE q3 END AS d FROM e),
x AS (SELECT a AS i, b AS j, 0 AS good FROM s UNION ALL SELECT c, d, 0 FROM s UNION ALL SELECT a, c, 1 FROM s UNION ALL SELECT a, d, 1 FROM s UNION ALL SELECT b, c, 1 FROM s UNION ALL SELECT b, d, 1 FROM s)
SELECT least(i, j) AS i, greatest(i, j) AS j, CAST(sum(good) AS DOUBLE) AS good, CAST(sum(1 - good) AS DOUBLE) AS bad FROM x GROUP BY ALL"""
)
def gene_tree_graph(spark, sf_dir):
    """Good and bad edges of the quartets that gene trees show, over all trees."""
    t = characters.newicks(characters.groups(fixtures.event_characters(spark, sf_dir)))
    return genetrees.tree_graph(t)


def weighted_trees(spark, sf_dir):
    """The characters as trees with lengths and supports: a leaf's length goes by its taxon, a clade's length and support by its size."""
    g = characters.groups(fixtures.event_characters(spark, sf_dir))
    leaf = F.transform("taxa", lambda t: F.concat(t.cast("string"), F.lit(":"), (t % 3 / 4).cast("string")))
    clade = F.when(F.col("n") > 1, F.concat(F.lit("("), F.array_join(leaf, ","), F.lit(")"), (1 / (F.col("n") + 1)).cast("string"), F.lit(":"), (F.col("n") / 16).cast("string"))).otherwise(leaf[0])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("state", clade.alias("c")))), lambda x: x["c"]), ",")
    return g.groupBy(F.col("pos").cast("long").alias("tree_id")).agg(F.concat(F.lit("("), joined, F.lit(");")).alias("newick"))


#: Quartets that weighted_trees show, a pair of one clade first, with weights by lengths and supports.
WEIGHTED = """, k AS (SELECT pos, n, state, unnest(taxa) AS taxon FROM g WHERE pos IN (SELECT pos FROM good)),
l AS (SELECT pos, state, CAST(taxon AS VARCHAR) AS taxon, taxon % 3 / 4.0::DOUBLE AS own, CASE WHEN n > 1 THEN n / 16.0::DOUBLE ELSE 0 END AS up, CASE WHEN n > 1 THEN 1 - 1 / (n + 1.0::DOUBLE) ELSE 1 END AS kept FROM k),
p AS (SELECT a.pos, a.taxon AS i, b.taxon AS j, a.state AS s, b.state AS t, a.own + b.own + CASE WHEN a.state = b.state THEN 0 ELSE a.up + b.up END AS len, CASE WHEN a.state = b.state THEN a.kept ELSE 1 END AS kept FROM l a JOIN l b ON a.pos = b.pos AND a.taxon < b.taxon),
q AS (SELECT x.pos, x.i AS a, x.j AS b, y.i AS c, y.j AS d, exp(-(x.len + y.len)) * (1 - x.kept * y.kept) AS w FROM p x JOIN p y ON x.pos = y.pos AND x.s = x.t AND y.s <> x.s AND y.t <> x.s AND (y.s <> y.t OR x.i < y.i))"""


@query(
    f"""WITH {fixtures.EVENT_CHARACTERS}{GROUPS}{WEIGHTED},
x AS (SELECT a AS i, b AS j, 0 AS good, w FROM q UNION ALL SELECT c, d, 0, w FROM q UNION ALL SELECT a, c, 1, w FROM q UNION ALL SELECT a, d, 1, w FROM q UNION ALL SELECT b, c, 1, w FROM q UNION ALL SELECT b, d, 1, w FROM q)
SELECT least(i, j) AS i, greatest(i, j) AS j, round(sum(good * w), 6) AS good, round(sum((1 - good) * w), 6) AS bad FROM x GROUP BY ALL"""
)
def weighted_tree_graph(spark, sf_dir):
    """Good and bad edges of weighted quartets, over trees whose clades have lengths and supports."""
    g = genetrees.tree_graph(weighted_trees(spark, sf_dir), weighting="h")
    return g.select("i", "j", F.round("good", 6).alias("good"), F.round("bad", 6).alias("bad"))


@query(f"WITH {fixtures.EVENT_CHARACTERS}{GROUPS}{WEIGHTED}, e AS (SELECT DISTINCT pos FROM k) SELECT CAST(e.pos AS BIGINT) AS tree_id, round(coalesce(sum(w), 0), 6) AS weight FROM e LEFT JOIN q USING (pos) GROUP BY ALL")
def tree_weights(spark, sf_dir):
    """The weight of all quartets of each of these trees."""
    return genetrees.total_weights(weighted_trees(spark, sf_dir), "h").select("tree_id", F.round("weight", 6).alias("weight"))


@query(f"{WITH_SPLITS} SELECT CAST(sum(w) FILTER (a < b AND b < c AND c < d) AS BIGINT) AS shown, CAST(sum(w) AS BIGINT) AS total FROM splits")
def tree_weight(spark, sf_dir):
    """Weight of the splits that a caterpillar tree over the labels shows, and of all."""
    return trees.total_weight(_splits(spark, sf_dir), _label_tree(spark, sf_dir))


@query(f"WITH {CLASSES} SELECT * FROM classes WHERE one <> two ORDER BY q0, q1, q2, q3 LIMIT 20")
def first_mismatches(spark, sf_dir):
    """Of 40 000 quartets of all customers, the first 20 on which two trees differ."""
    one, two, q = _two_trees(spark, sf_dir)
    return trees.mismatches(q, one, two, 20)


BRANCHES = "b AS (SELECT o_orderkey AS id, o_custkey % 100 / 100 AS support, o_orderstatus <> 'O' OR o_custkey % 7 = 0 AS correct FROM orders)"


def _branches(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 100 / 100).alias("support"), ((F.col("o_orderstatus") != "O") | (F.col("o_custkey") % 7 == 0)).alias("correct"))


@query(
    f"""WITH {BRANCHES}, r AS (SELECT *, rank() OVER (ORDER BY support) + (count(*) OVER (PARTITION BY support) - 1) / 2 AS rk FROM b),
a AS (SELECT count(*) AS n, count(*) FILTER (correct) AS p, sum(rk) FILTER (correct) AS s FROM r),
c AS (SELECT least(9, floor(support * 10)) AS bin, count(*) AS c, avg(support) AS s, avg(CAST(correct AS DOUBLE)) AS a FROM b GROUP BY 1)
SELECT n, round((s - p * (p + 1) / 2) / (CAST(p AS DOUBLE) * (n - p)), 9) AS auc, round((SELECT sum(c * abs(s - a)) / sum(c) FROM c), 9) AS ece FROM a"""
)
def support_reliability(spark, sf_dir):
    return support.reliability(_branches(spark, sf_dir)).select("n", F.round("auc", 9).alias("auc"), F.round("ece", 9).alias("ece"))


@query(
    f"""WITH {BRANCHES}, r AS (SELECT *, row_number() OVER (ORDER BY support, id) AS k, count(*) OVER () AS n FROM b)
SELECT share, count(*) FILTER (k <= ceil(share * n)) AS branches, round(count(*) FILTER (NOT correct AND k <= ceil(share * n)) / count(*) FILTER (NOT correct), 9) AS recall
FROM r CROSS JOIN (SELECT unnest([0.1::DOUBLE, 0.2::DOUBLE, 0.3::DOUBLE]) AS share) GROUP BY share"""
)
def support_tail_recall(spark, sf_dir):
    """How many of the wrong branches are among those of least support."""
    return support.tail_recall(_branches(spark, sf_dir), "id").withColumn("recall", F.round("recall", 9))


@query(
    f"""WITH {fixtures.geo_sql('t')} SELECT t.node_id, CASE WHEN p.node_id LIKE 'n%' AND TRY_CAST(substr(p.node_id, 2) AS INTEGER) % 2 = 1 THEN p.parent_id ELSE t.parent_id END AS parent_id, t.name, t.is_leaf
FROM t LEFT JOIN t p ON t.parent_id = p.node_id WHERE NOT (t.node_id LIKE 'n%' AND coalesce(TRY_CAST(substr(t.node_id, 2) AS INTEGER), 0) % 2 = 1)"""
)
def contracted_tree(spark, sf_dir):
    """The tree of customers without every other nation."""
    t = written(fixtures.geo_tree(spark, sf_dir), "tree")
    odd = t.filter("node_id like 'n%'").filter(F.substring("node_id", 2, 9).cast("int") % 2 == 1).select("node_id")
    return trees.contracted(t, odd)


@query(f"WITH {fixtures.WEIGHTS}, {fixtures.splits_sql('weights', '')} SELECT * FROM splits")
def stream_agg_off(spark, sf_dir):
    """Every row's splits, from a stream of files."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    w = fixtures.weights(spark, sf_dir).select("block_id", *sites.Q, "w0", "w1", "w2")
    w.repartition(4, "block_id").write.parquet(f"{base}/in")
    return aggregate.run(aggregate.read(spark, f"{base}/in"), "off", f"{base}/out", f"{base}/state")


def supplier_splits(spark, sf_dir):
    """Splits over all suppliers, one or none from each line item: as a caterpillar in order of key shows them, but for every tenth part's."""
    n = fixtures.table(spark, sf_dir, "supplier").count()
    item = fixtures.table(spark, sf_dir, "lineitem")
    ids = [F.pmod(F.xxhash64("l_orderkey", "l_linenumber", F.lit(k)), F.lit(n)) for k in range(4)]
    four = item.select(F.sort_array(F.array_distinct(F.array(*ids))).alias("q"), (F.col("l_partkey") % 10 == 0).alias("odd"), F.col("l_quantity").alias("w")).filter(F.size("q") == 4)
    b, c = F.when(F.col("odd"), F.col("q")[2]).otherwise(F.col("q")[1]), F.when(F.col("odd"), F.col("q")[1]).otherwise(F.col("q")[2])
    return four.select(F.col("q")[0].alias("a"), b.alias("b"), c.alias("c"), F.col("q")[3].alias("d"), "w")


@query()
def assemble_suppliers(spark, sf_dir):
    """A tree of all suppliers from one split a line item."""
    return _table(spark, assemble(supplier_splits(spark, sf_dir)))


@query()
def species_tree(spark, sf_dir):
    """The tree that max-cut assembles from the characters as gene trees, none of whose quartets is listed."""
    t = characters.newicks(characters.groups(fixtures.event_characters(spark, sf_dir)))
    return _table(spark, assemble_gene_trees(t))
