"""The registered queries of the quartet engine and their SQL twins, all over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar, statistics
from ..operators import blobs, characters, design, graph, sites, splits, support, trees
from ..sources import alignments, quartets
from ..sources.tables import shared_dir, written
from ..streaming import aggregate
from . import fixtures, newick
from .assemble import assemble
from .infer import _table, infer, repaired

FOUND: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        FOUND[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _splits(spark: SparkSession, sf_dir: str, mode: str = "full") -> DataFrame:
    return splits.to_splits(splits.aggregated(fixtures.weights(spark, sf_dir), mode))


WITH_SPLITS = f"WITH {fixtures.WEIGHTS}, {fixtures.splits_sql('weights')}"


@query(
    """SELECT doc_id, state, count(*) AS n FROM (
  SELECT doc_id, CASE upper(ch) WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 4 END AS state
  FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents WHERE text <> '')) GROUP BY ALL"""
)
def encode_sites(spark, sf_dir):
    """Documents as sequences: how often each state occurs, counted in place."""
    d = fixtures.table(spark, sf_dir, "documents").filter("text <> ''")
    return scalar.state_counts(d, "text", "doc_id")


@query(
    f"""WITH {fixtures.LABEL_SITES}, kept AS (SELECT pos FROM label_sites GROUP BY pos HAVING count(DISTINCT state) > 1)
SELECT taxon, CAST(dense_rank() OVER (ORDER BY pos) - 1 AS BIGINT) AS pos, state FROM label_sites JOIN kept USING (pos)"""
)
def drop_conserved(spark, sf_dir):
    return sites.informative(fixtures.label_sites(spark, sf_dir))


@query(f"WITH {fixtures.BLOCKS} SELECT * FROM block_quartets")
def quartets_all(spark, sf_dir):
    return sites.block_quartets(fixtures.blocks(spark, sf_dir))


@query(f"WITH {fixtures.BLOCKS} SELECT * FROM block_quartets")
def quartets_joined(spark, sf_dir):
    """The same by joins of a members table."""
    return sites.quartets(fixtures.blocks(spark, sf_dir).select("block_id", F.explode("members").alias("taxon")))


PATTERNS = f"WITH {fixtures.WEIGHTS} SELECT q0, q1, q2, q3, pat, n, round(n / sum(n) OVER (PARTITION BY q0, q1, q2, q3), 9) AS freq FROM patterns"


@query(PATTERNS)
def site_patterns(spark, sf_dir):
    rows = written(sites.informative(fixtures.label_sites(spark, sf_dir)), "sites")
    q = sites.block_quartets(fixtures.blocks(spark, sf_dir)).select(*sites.Q).distinct()
    return sites.site_patterns(q, rows).withColumn("freq", F.round("freq", 9))


@query(f"WITH {fixtures.WEIGHTS} SELECT * FROM patterns")
def site_patterns_kernel(spark, sf_dir):
    rows = written(sites.informative(fixtures.label_sites(spark, sf_dir)), "sites")
    q = sites.block_quartets(fixtures.blocks(spark, sf_dir)).select(*sites.Q).distinct()
    return sites.pattern_counts(q, rows)


@query(f"WITH {fixtures.WEIGHTS} SELECT block_id, q0, q1, q2, q3, round(w0, 6) AS w0, round(w1, 6) AS w1, round(w2, 6) AS w2 FROM weights")
def quartet_scores(spark, sf_dir):
    return fixtures.weights(spark, sf_dir).select("block_id", *sites.Q, *(F.round(w, 6).alias(w) for w in splits.W))


def _agg_sql(by: str) -> str:
    if not by:
        return f"WITH {fixtures.WEIGHTS} SELECT q0, q1, q2, q3, round(w0, 6) AS s0, round(w1, 6) AS s1, round(w2, 6) AS s2, CAST(1 AS BIGINT) AS n FROM weights"
    return f"WITH {fixtures.WEIGHTS} SELECT q0, q1, q2, q3, round(sum(w0), 6) AS s0, round(sum(w1), 6) AS s1, round(sum(w2), 6) AS s2, count(*) AS n FROM weights GROUP BY {by}"


def _agg(spark, sf_dir, mode):
    return splits.aggregated(fixtures.weights(spark, sf_dir), mode).select(*sites.Q, *(F.round(f"s{k}", 6).alias(f"s{k}") for k in range(3)), "n")


@query(_agg_sql("q0, q1, q2, q3"))
def quartet_agg_full(spark, sf_dir):
    return _agg(spark, sf_dir, "full")


@query(_agg_sql("block_id, q0, q1, q2, q3"))
def quartet_agg_batch_only(spark, sf_dir):
    return _agg(spark, sf_dir, "batch_only")


@query(_agg_sql(""))
def quartet_agg_off(spark, sf_dir):
    return _agg(spark, sf_dir, "off")


@query(f"{WITH_SPLITS} SELECT * FROM splits")
def split_weights(spark, sf_dir):
    """The flagship: sites to patterns to scores to aggregated splits."""
    return _splits(spark, sf_dir)


@query(
    f"""WITH {fixtures.WEIGHTS}, top AS (SELECT q0, q1, q2, q3, CASE WHEN w0 = greatest(w0, w1, w2) THEN w0 ELSE 0 END AS w0,
  CASE WHEN w0 < greatest(w0, w1, w2) AND w1 = greatest(w0, w1, w2) THEN w1 ELSE 0 END AS w1, CASE WHEN w0 < greatest(w0, w1, w2) AND w1 < greatest(w0, w1, w2) THEN w2 ELSE 0 END AS w2 FROM weights),
{fixtures.splits_sql('top')} SELECT * FROM splits"""
)
def splits_top1(spark, sf_dir):
    return splits.to_splits(splits.aggregated(splits.top1(fixtures.weights(spark, sf_dir)), "full"))


@query(f"WITH {fixtures.WEIGHTS}, {fixtures.splits_sql('weights', '')} SELECT a, b, c, d, CAST(sum(w) AS BIGINT) AS w FROM splits GROUP BY ALL")
def dedup_splits(spark, sf_dir):
    return splits.summed(_splits(spark, sf_dir, "off"))


@query(f"WITH {fixtures.WEIGHTS}, {fixtures.splits_sql('weights', '')} SELECT a, b, c, d, count(*) AS freq FROM splits GROUP BY ALL")
def split_frequency(spark, sf_dir):
    rows = _splits(spark, sf_dir, "off").select(F.col("d").alias("a"), F.col("c").alias("b"), F.col("b").alias("c"), F.col("a").alias("d"))
    return splits.frequency(rows)


GRAPH = """, e AS (
  SELECT a AS i, b AS j, 0 AS good, w FROM splits UNION ALL SELECT c, d, 0, w FROM splits UNION ALL SELECT a, c, 1, w FROM splits
  UNION ALL SELECT a, d, 1, w FROM splits UNION ALL SELECT b, c, 1, w FROM splits UNION ALL SELECT b, d, 1, w FROM splits),
graph AS (SELECT least(i, j) AS i, greatest(i, j) AS j, CAST(sum(CASE WHEN good = 1 THEN w ELSE 0 END) AS BIGINT) AS good, CAST(sum(CASE WHEN good = 0 THEN w ELSE 0 END) AS BIGINT) AS bad FROM e GROUP BY ALL)"""


@query(f"{WITH_SPLITS}{GRAPH} SELECT * FROM graph")
def quartet_graph(spark, sf_dir):
    return graph.quartet_graph(_splits(spark, sf_dir))


@query(f"{WITH_SPLITS}{GRAPH} SELECT i, j, round(good / (SELECT min(good) FROM graph WHERE good > 1), 9) AS w FROM graph")
def good_edges(spark, sf_dir):
    return graph.edge_matrix(written(graph.quartet_graph(_splits(spark, sf_dir)), "graph"), "good").withColumn("w", F.round("w", 9))


def _sides(spark, sf_dir):
    return fixtures.label_sites(spark, sf_dir).select("taxon").distinct().withColumn("side", (F.col("taxon") % 2).cast("int"))


SIDES = ", x AS (SELECT *, a % 2 + b % 2 + c % 2 + d % 2 AS k FROM splits)"


@query(
    f"""{WITH_SPLITS}{SIDES} SELECT CASE WHEN k IN (0, 4) THEN 'same' WHEN k <> 2 THEN 'deferred' WHEN a % 2 = b % 2 THEN 'satisfied' ELSE 'violated' END AS status,
count(*) AS n, CAST(sum(w) AS BIGINT) AS w FROM x GROUP BY 1"""
)
def cut_scores(spark, sf_dir):
    return graph.cut_scores(_splits(spark, sf_dir), _sides(spark, sf_dir))


@query(
    f"""{WITH_SPLITS}{SIDES}, y AS (SELECT CAST(k > 2 AS INTEGER) AS side, k IN (1, 3) AS lone, a, b, c, d, w FROM x WHERE k <> 2),
z AS (SELECT side, CASE WHEN lone AND a % 2 <> side THEN -1 ELSE a END AS a, CASE WHEN lone AND b % 2 <> side THEN -1 ELSE b END AS b,
  CASE WHEN lone AND c % 2 <> side THEN -1 ELSE c END AS c, CASE WHEN lone AND d % 2 <> side THEN -1 ELSE d END AS d, w FROM y),
p AS (SELECT side, least(a, b) AS a, greatest(a, b) AS b, least(c, d) AS c, greatest(c, d) AS d, w FROM z),
u AS (SELECT side, CASE WHEN a < c OR (a = c AND b <= d) THEN [a, b, c, d] ELSE [c, d, a, b] END AS s, w FROM p)
SELECT side, s[1] AS a, s[2] AS b, s[3] AS c, s[4] AS d, CAST(sum(w) AS BIGINT) AS w FROM u GROUP BY ALL"""
)
def subproblem_relabel(spark, sf_dir):
    return graph.divided(_splits(spark, sf_dir), _sides(spark, sf_dir), F.lit(-1).cast("long"))


def _fixed_tree(taxa: list[int]) -> newick.Node:
    """((0,1),(2,(3,(4,...)))): a tree whose shape depends on the number of taxa only."""
    text = str(taxa[-1])
    for t in reversed(taxa[2:-1]):
        text = f"({t},{text})"
    return newick.parse(f"(({taxa[0]},{taxa[1]}),{text});")


def _label_tree(spark, sf_dir):
    taxa = sorted(r["label"] for r in fixtures.table(spark, sf_dir, "embeddings").select("label").distinct().collect())
    return _table(spark, _fixed_tree(taxa))


@query(
    f"""{WITH_SPLITS}, t AS (SELECT taxon, row_number() OVER (ORDER BY taxon) - 1 AS r FROM (SELECT DISTINCT taxon FROM label_sites)),
k AS (SELECT unnest(range(1, (SELECT count(*) - 2 FROM t))) AS k),
p AS (SELECT k, taxon, CASE WHEN r > k + 1 THEN 1 WHEN r = k + 1 THEN 2 WHEN r = k THEN 4 ELSE 8 END AS code FROM k, t),
x AS (SELECT pa.k, pa.code + pb.code AS pair, w FROM splits JOIN p pa ON a = pa.taxon JOIN p pb ON b = pb.taxon AND pb.k = pa.k JOIN p pc ON c = pc.taxon AND pc.k = pa.k JOIN p pd ON d = pd.taxon AND pd.k = pa.k
  WHERE pa.code | pb.code | pc.code | pd.code = 15),
f AS (SELECT k, CAST(coalesce(sum(w) FILTER (pair IN (3, 12)), 0) AS DOUBLE) AS f1, CAST(coalesce(sum(w) FILTER (pair IN (5, 10)), 0) AS DOUBLE) AS f2, CAST(coalesce(sum(w) FILTER (pair IN (6, 9)), 0) AS DOUBLE) AS f3 FROM k LEFT JOIN x USING (k) GROUP BY k),
e AS (SELECT *, f1 + f2 + f3 AS en, CASE WHEN en > 0 THEN f1 / en ELSE 0 END AS q1 FROM f), j AS (SELECT *, unnest([1, 2, 3]) AS j FROM e)
SELECT 'N' || k AS node, 't' || j AS tree, CASE j WHEN 1 THEN f1 WHEN 2 THEN f2 ELSE f3 END AS qfreq, en, CASE WHEN en > 0 THEN qfreq / en ELSE 0 END AS qsupp,
  CASE WHEN j > 1 THEN 'NA' ELSE printf('%.6f', CASE WHEN q1 <= 1 / 3 THEN 0.0 WHEN q1 >= 1 THEN 9.0 ELSE -ln(1.5 * (1 - q1)) END) END AS brlen FROM j"""
)
def branch_support(spark, sf_dir):
    """Support around the branches of a caterpillar tree over the labels."""
    rows = support.support(support.frequencies(_splits(spark, sf_dir), _label_tree(spark, sf_dir)))
    return support.support_table(rows)


@query(
    f"""WITH RECURSIVE {fixtures.geo_sql('t')}, r AS (SELECT node_id AS anc, node_id, 0 AS dist FROM t
UNION ALL SELECT t.parent_id, r.node_id, r.dist + 1 FROM r JOIN t ON r.anc = t.node_id WHERE t.parent_id IS NOT NULL)
SELECT anc, name AS leaf, dist FROM r JOIN t USING (node_id) WHERE is_leaf"""
)
def leaf_closure(spark, sf_dir):
    return trees.leaf_closure(fixtures.geo_tree(spark, sf_dir))


GEO_SETS = """, r AS (SELECT node_id AS anc, node_id, 0 AS dist FROM t
UNION ALL SELECT t.parent_id, r.node_id, r.dist + 1 FROM r JOIN t ON r.anc = t.node_id WHERE t.parent_id IS NOT NULL),
l AS (SELECT anc, name AS leaf FROM r JOIN t USING (node_id) WHERE is_leaf)"""


@query(
    f"""WITH RECURSIVE {fixtures.geo_sql('t')}{GEO_SETS},
d AS (SELECT t.node_id, t.parent_id, count(k.node_id) + CAST(t.parent_id IS NOT NULL AS INTEGER) AS degree FROM t JOIN t k ON k.parent_id = t.node_id GROUP BY t.node_id, t.parent_id HAVING degree > 3)
SELECT d.node_id, CAST(degree AS BIGINT) AS degree, k.node_id AS direction, min(leaf) AS rep FROM d JOIN t k ON k.parent_id = d.node_id JOIN l ON l.anc = k.node_id GROUP BY ALL
UNION ALL SELECT d.node_id, CAST(degree AS BIGINT), NULL, (SELECT min(name) FROM t x WHERE x.is_leaf AND x.name NOT IN (SELECT leaf FROM l WHERE l.anc = d.node_id)) FROM d WHERE parent_id IS NOT NULL"""
)
def polytomies(spark, sf_dir):
    return trees.polytomies(fixtures.geo_tree(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {fixtures.geo_sql('t')}{GEO_SETS}, a AS (SELECT list(name ORDER BY name) AS every, count(*) AS total, min(name) AS least FROM t WHERE is_leaf),
s AS (SELECT anc, list(leaf ORDER BY leaf) AS s, count(*) AS k FROM l GROUP BY anc)
SELECT anc AS node_id, CASE WHEN s[1] = least THEN total - k ELSE k END AS n,
  sha256(array_to_string(CASE WHEN s[1] = least THEN list_filter(every, lambda x: NOT list_contains(s, x)) ELSE s END, ',')) AS side_sha256
FROM s, a WHERE k >= 2 AND total - k >= 2"""
)
def bipartitions(spark, sf_dir):
    rows = trees.bipartitions(fixtures.geo_tree(spark, sf_dir))
    return rows.select("node_id", F.col("n").cast("long").alias("n"), F.sha2(F.array_join("side", ","), 256).alias("side_sha256"))


RF = """, {0}r AS (SELECT node_id AS anc, node_id FROM {0} UNION ALL SELECT {0}.parent_id, {0}r.node_id FROM {0}r JOIN {0} ON {0}r.anc = {0}.node_id WHERE {0}.parent_id IS NOT NULL),
{0}l AS (SELECT anc, name AS leaf FROM {0}r JOIN {0} USING (node_id) WHERE is_leaf),
{0}k AS (SELECT DISTINCT string_agg(leaf, ',' ORDER BY leaf) AS s FROM {0}l GROUP BY anc HAVING count(*) BETWEEN 2 AND (SELECT count(*) - 2 FROM {0} WHERE is_leaf))"""


@query(
    f"""WITH RECURSIVE {fixtures.geo_sql('a')}, {fixtures.geo_sql('b', True)}{RF.format('a')}{RF.format('b')},
c AS (SELECT (SELECT count(*) FROM ak WHERE s NOT IN (SELECT s FROM bk)) AS only_1, (SELECT count(*) FROM bk WHERE s NOT IN (SELECT s FROM ak)) AS only_2, (SELECT count(*) FROM ak WHERE s IN (SELECT s FROM bk)) AS shared)
SELECT only_1, only_2, shared, round((only_1 + only_2) / (only_1 + only_2 + 2 * shared), 9) AS rf, round(only_1 / (only_1 + shared), 9) AS fp_rate, round(only_2 / (only_2 + shared), 9) AS fn_rate FROM c"""
)
def rf_distance(spark, sf_dir):
    r = trees.rf(fixtures.geo_tree(spark, sf_dir), fixtures.geo_tree(spark, sf_dir, True))
    return r.select("only_1", "only_2", "shared", *(F.round(c, 9).alias(c) for c in ("rf", "fp_rate", "fn_rate")))


def _classes_sql() -> str:
    """WITH items for quartets of customers drawn by a hash, and the classes that geo_tree and the moved one show of each: classes(q0..q3, one, two)."""
    level = lambda r, a, b: f"CASE WHEN k[{a}] = k[{b}] THEN 2 WHEN {r}[{a}] = {r}[{b}] THEN 1 ELSE 0 END"
    deepest = lambda r: "[" + ", ".join(f"greatest({level(r, *p[:2])}, {level(r, *p[2:])})" for p in ((1, 2, 3, 4), (1, 3, 2, 4), (1, 4, 2, 3))) + "]"
    cls = lambda c: f"CAST(CASE WHEN len(list_filter({c}, lambda z: z = list_max({c}))) > 1 THEN -1 ELSE list_position({c}, list_max({c})) - 1 END AS INTEGER)"
    return f"""c AS (SELECT c_name AS name, row_number() OVER (ORDER BY c_name) - 1 AS r, c_nationkey AS k, n_regionkey AS x, CASE WHEN n_nationkey = 0 THEN 4 ELSE n_regionkey END AS y FROM customer JOIN nation ON c_nationkey = n_nationkey),
s AS (SELECT DISTINCT i, CAST('0x' || substr(md5('0:' || i || ':' || j), 1, 8) AS BIGINT) % (SELECT count(*) FROM c) AS r FROM range(40000) t(i), range(4) u(j)),
g AS (SELECT list(name ORDER BY name) AS q, list(k ORDER BY name) AS k, list(x ORDER BY name) AS x, list(y ORDER BY name) AS y FROM s JOIN c USING (r) GROUP BY i HAVING count(*) = 4),
d AS (SELECT q, {deepest('x')} AS u, {deepest('y')} AS v FROM (SELECT q, any_value(k) AS k, any_value(x) AS x, any_value(y) AS y FROM g GROUP BY q)),
classes AS (SELECT q[1] AS q0, q[2] AS q1, q[3] AS q2, q[4] AS q3, {cls('u')} AS one, {cls('v')} AS two FROM d)"""


CLASSES = _classes_sql()


def _two_trees(spark, sf_dir):
    """(geo_tree, the one with a nation moved, some quartets of their leaves, which are all customers)."""
    one, two = fixtures.geo_tree(spark, sf_dir), fixtures.geo_tree(spark, sf_dir, True)
    return one, two, trees.sampled(one.filter("is_leaf").select("name"), 40_000)


@query(f"WITH {CLASSES} SELECT count(*) AS evaluated, count(*) FILTER (one = two) AS matches, round(count(*) FILTER (one = two) / count(*), 9) AS concordance FROM classes")
def quartet_concordance(spark, sf_dir):
    """Of 40 000 quartets of all customers, how many two trees resolve alike."""
    one, two, q = _two_trees(spark, sf_dir)
    return trees.concordance(q, one, two).withColumn("concordance", F.round("concordance", 9))


GROUPS = """, g AS (SELECT pos, state, list(taxon ORDER BY taxon) AS taxa, count(*) AS n FROM (SELECT DISTINCT pos, taxon, state FROM chars WHERE state NOT IN ('?', '-', 'N')) GROUP BY ALL),
good AS (SELECT pos FROM g GROUP BY pos HAVING count(*) FILTER (n >= 2) >= 2 AND sum(n) >= 4)"""


@query(f"WITH {fixtures.EVENT_CHARACTERS}{GROUPS} SELECT pos, state, array_to_string(taxa, ',') AS taxa, CAST(n AS INTEGER) AS n FROM g WHERE pos IN (SELECT pos FROM good)")
def char_to_groups(spark, sf_dir):
    rows = characters.groups(fixtures.event_characters(spark, sf_dir))
    return rows.select("pos", "state", F.array_join(F.col("taxa").cast("array<string>"), ",").alias("taxa"), "n")


@query(
    f"""WITH {fixtures.EVENT_CHARACTERS}{GROUPS}, c AS (SELECT pos, state, CASE WHEN n > 1 THEN '(' || array_to_string(taxa, ',') || ')' ELSE CAST(taxa[1] AS VARCHAR) END AS clade FROM g WHERE pos IN (SELECT pos FROM good))
SELECT pos AS tree_id, '(' || string_agg(clade, ',' ORDER BY state) || ');' AS newick FROM c GROUP BY pos"""
)
def char_newicks(spark, sf_dir):
    return characters.newicks(characters.groups(fixtures.event_characters(spark, sf_dir)))


QCF = """, k AS (SELECT * FROM chars WHERE state NOT IN ('?', '-', 'N')),
m AS (SELECT a.taxon AS q0, b.taxon AS q1, c.taxon AS q2, d.taxon AS q3,
  CASE WHEN a.state = b.state AND c.state = d.state AND a.state <> c.state THEN 0 WHEN a.state = c.state AND b.state = d.state AND a.state <> b.state THEN 1
       WHEN a.state = d.state AND b.state = c.state AND a.state <> b.state THEN 2 END AS cls
  FROM k a JOIN k b ON a.pos = b.pos AND a.taxon < b.taxon JOIN k c ON a.pos = c.pos AND b.taxon < c.taxon JOIN k d ON a.pos = d.pos AND c.taxon < d.taxon),
qcf AS (SELECT q0, q1, q2, q3, count(*) FILTER (cls = 0) AS n0, count(*) FILTER (cls = 1) AS n1, count(*) FILTER (cls = 2) AS n2 FROM m WHERE cls IS NOT NULL GROUP BY ALL)"""


@query(f"WITH {fixtures.EVENT_CHARACTERS}{QCF} SELECT * FROM qcf")
def qcf_table(spark, sf_dir):
    return characters.concordance(fixtures.event_characters(spark, sf_dir))


@query(f"WITH {fixtures.EVENT_CHARACTERS}{QCF} SELECT q0, q1, q2, q3, round(exp(-((n0 - t) * (n0 - t) + (n1 - t) * (n1 - t) + (n2 - t) * (n2 - t)) / t / 2), 9) AS p FROM (SELECT *, (n0 + n1 + n2) / 3.0::DOUBLE AS t FROM qcf)")
def star_test(spark, sf_dir):
    c = characters.concordance(fixtures.event_characters(spark, sf_dir))
    return c.select(*sites.Q, F.round(statistics.star_test(*(F.col(f"n{k}") for k in range(3))), 9).alias("p"))


@query()
def tree_test(spark, sf_dir):
    c = characters.concordance(fixtures.event_characters(spark, sf_dir))
    return blobs.with_p(c).select(*sites.Q, "n0", "n1", "n2", "p_tree", "p_star")


@query()
def blob_search(spark, sf_dir):
    """The least tree p-value around each branch of a caterpillar tree over the user groups."""
    c = written(blobs.with_p(characters.concordance(fixtures.event_characters(spark, sf_dir))), "qcf")
    taxa = sorted(r["taxon"] for r in fixtures.event_characters(spark, sf_dir).select("taxon").distinct().collect())
    table = _table(spark, _fixed_tree(taxa))
    quads = support.quadripartitions(table).withColumn("taxon", F.col("taxon").cast("long"))
    return blobs.searched(c, written(quads, "quads"))


@query()
def blob_descent(spark, sf_dir):
    """The same p-value by descents, whose quartets are counted on demand in the characters as trees."""
    t = characters.newicks(characters.groups(fixtures.event_characters(spark, sf_dir)))
    taxa = sorted(r["taxon"] for r in fixtures.table(spark, sf_dir, "events").select((F.col("user_id") % 12).alias("taxon")).distinct().collect())
    return blobs.descended(t, _table(spark, _fixed_tree(taxa)))[0]


@query("""SELECT c_name AS taxon, CAST(CASE WHEN fits THEN k ELSE c_custkey END AS INTEGER) AS taxon_id FROM (
  SELECT c_name, c_custkey, CAST(regexp_extract(c_name, '(\\d+)', 1) AS BIGINT) AS k FROM customer),
  (SELECT count(*) = count(DISTINCT k) AND min(k) = 0 AND max(k) = count(*) - 1 AS fits FROM (SELECT CAST(regexp_extract(c_name, '(\\d+)', 1) AS BIGINT) AS k FROM customer))""")
def numbered_reorder(spark, sf_dir):
    c = fixtures.table(spark, sf_dir, "customer").select(F.col("c_name").alias("taxon"), F.col("c_custkey").cast("int").alias("taxon_id"))
    return alignments.renumbered(c).select("taxon", "taxon_id")


@query(
    f"""WITH {fixtures.BLOCKS}, q AS (SELECT DISTINCT q0, q1, q2, q3 FROM block_quartets), k AS (SELECT *, ((q0 * 100 + q1) * 100 + q2) * 100 + q3 AS qid FROM q), t AS (SELECT qid, unnest([q0, q1, q2, q3]) AS taxon FROM k)
SELECT a.qid AS l, b.qid AS r, count(*) AS shared FROM t a JOIN t b ON a.taxon = b.taxon AND a.qid < b.qid GROUP BY ALL HAVING count(*) >= 3"""
)
def shared_taxon_pairs(spark, sf_dir):
    q = sites.block_quartets(fixtures.blocks(spark, sf_dir)).select(*sites.Q).distinct()
    return sites.shared_taxon_pairs(q.withColumn("qid", ((F.col("q0") * 100 + F.col("q1")) * 100 + F.col("q2")) * 100 + F.col("q3")))


@query(f"{WITH_SPLITS} SELECT a || ',' || b || '|' || c || ',' || d || ':' || w AS value FROM splits")
def split_lines(spark, sf_dir):
    return quartets.split_lines(_splits(spark, sf_dir))


@query(f"{WITH_SPLITS} SELECT CAST(a AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b, CAST(c AS VARCHAR) AS c, CAST(d AS VARCHAR) AS d, CAST(sum(w) AS DOUBLE) AS w FROM splits GROUP BY a, b, c, d")
def parse_split_lines(spark, sf_dir):
    """Written in one layout and read back by its template."""
    return quartets.summed(quartets.parse_quartets(quartets.split_lines(_splits(spark, sf_dir), "qfm"), quartets.QFM))


def _part_splits(spark, sf_dir):
    """Splits over the ten residues of suppliers, one or none from each line item, in a subproblem for each size of parts."""
    item = fixtures.table(spark, sf_dir, "lineitem")
    part = fixtures.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("long").alias("sub_id"))
    ids = [F.pmod(F.xxhash64("l_orderkey", "l_linenumber", F.lit(k)), F.lit(10)) for k in range(4)]
    four = item.join(part, "l_partkey").select("sub_id", F.array_sort(F.array_distinct(F.array(*ids))).alias("q"), F.col("l_quantity").alias("w")).filter(F.size("q") == 4)
    return four.groupBy("sub_id", *(F.col("q")[k].alias(x) for k, x in enumerate("abcd"))).agg(F.sum("w").alias("w"))


@query()
def fm_partition(spark, sf_dir):
    """Bipartitions by single moves, one subproblem for each size of parts."""
    return graph.bipartitions(_part_splits(spark, sf_dir), "qfm")


@query()
def maxcut_partition(spark, sf_dir):
    """The same by max-cut."""
    return graph.bipartitions(_part_splits(spark, sf_dir), "qmc")


@query()
def assemble_tree(spark, sf_dir):
    return _table(spark, assemble(_splits(spark, sf_dir)))


@query()
def polytomy_repair(spark, sf_dir):
    """A star over all labels, resolved by scored quartets."""
    rows = written(sites.informative(fixtures.label_sites(spark, sf_dir)), "sites")
    ids = sorted(r["taxon"] for r in rows.select("taxon").distinct().collect())
    star = newick.parse("(" + ",".join(map(str, ids)) + ");")
    return _table(spark, repaired(star, rows)[0])


@query()
def newick_nodes(spark, sf_dir):
    return trees.parsed(characters.newicks(characters.groups(fixtures.event_characters(spark, sf_dir))))


@query()
def block_design(spark, sf_dir):
    """Blocks of 24 over all kinds of parts, which are brands of one size."""
    kinds = written(fixtures.table(spark, sf_dir, "part").select(F.concat_ws("-", "p_brand", "p_size").alias("kind")).distinct(), "kinds")
    numbered = trees.ranked(kinds, "kind").select(F.col("new").alias("place"), F.col("kind").alias("taxon"))
    blocks = design.design(spark, kinds.count(), 2.5)
    return blocks.select("block_id", F.explode("members").alias("place")).join(numbered, "place").select("block_id", "taxon")


@query(f"{WITH_SPLITS} SELECT * FROM splits")
def stream_agg_parity(spark, sf_dir):
    """The batch result, from a stream of files."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    w = fixtures.weights(spark, sf_dir).select("block_id", *sites.Q, "w0", "w1", "w2")
    w.repartition(4, "block_id").write.parquet(f"{base}/in")
    return aggregate.run(aggregate.read(spark, f"{base}/in"), "full", f"{base}/out", f"{base}/state")


@query()
def infer_tree(spark, sf_dir):
    """The whole way from sequences to a tree with support, over the labels in blocks of eight."""
    rows = fixtures.label_sites(spark, sf_dir)
    letters = F.element_at(F.array(*map(F.lit, "ACGT-")), F.col("state") + 1)
    seq = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", letters.alias("c")))), lambda x: x["c"]), "")
    aligned = rows.groupBy("taxon").agg(seq.alias("seq")).select(F.col("taxon").cast("int").alias("taxon_id"), F.concat(F.lit("label"), "taxon").alias("taxon"), "seq")
    longest = aligned.agg(F.max(F.length("seq"))).first()[0]
    tree = infer(aligned.withColumn("seq", F.rpad("seq", longest, "-")), quartets.Config(compute_branch_support=True), block=8)
    return _table(spark, tree)


from . import relations  # noqa: E402, F401
