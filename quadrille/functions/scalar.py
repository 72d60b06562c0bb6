"""Column expressions on states, splits, supports and lengths. All of them stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States of a site: A, C, G, T in either case; whatever else is a gap, which is a value and not null.
STATES = "ACGT"
GAP = 4


def state(base: Column) -> Column:
    """Base to state 0-3, anything else GAP."""
    upper = F.upper(base)
    chain = F.when(upper == "A", F.lit(0))
    for code, letter in enumerate("CGT", 1):
        chain = chain.when(upper == letter, F.lit(code))
    return chain.otherwise(F.lit(GAP))


def states(seq: Column) -> Column:
    """A sequence as an array of states."""
    return F.transform(F.split(seq, ""), lambda b: state(b).cast("tinyint"))


def state_counts(rows: DataFrame, column: str, *keep: str) -> DataFrame:
    """(keep, state, n): how often each state occurs in a sequence, without making a row a site."""
    without = lambda c: F.replace(F.replace(F.col(column), F.lit(c), F.lit("")), F.lit(c.lower()), F.lit(""))
    found = [F.length(column) - F.length(without(c)) for c in STATES]
    gaps = F.length(column) - sum(found[1:], found[0])
    each = F.array(*(F.struct(F.lit(k).alias("state"), n.cast("long").alias("n")) for k, n in enumerate([*found, gaps])))
    return rows.select(*keep, F.explode(each).alias("s")).select(*keep, "s.*").filter("n > 0")


def pattern(*s: Column) -> Column:
    """Site pattern of four states, 0 to 255."""
    a, b, c, d = s
    return a * 64 + b * 16 + c * 4 + d


def valid(*s: Column) -> Column:
    """All four states are bases."""
    a, b, c, d = s
    return (a < GAP) & (b < GAP) & (c < GAP) & (d < GAP)


def canonical(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The split ab|cd as a struct: each pair in order, the pair with the smaller first taxon first."""
    one, two = F.struct(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")), F.struct(F.least(c, d).alias("x"), F.greatest(c, d).alias("y"))
    first, second = F.least(one, two), F.greatest(one, two)
    return F.struct(first["x"].alias("a"), first["y"].alias("b"), second["x"].alias("c"), second["y"].alias("d"))


def pairing(cls: int, q: tuple[str, str, str, str] = ("q0", "q1", "q2", "q3")) -> tuple[str, str, str, str]:
    """The two pairs of a sorted quartet's class: 01|23, 02|13, 03|12."""
    w, x, y, z = q
    return ((w, x, y, z), (w, y, x, z), (w, z, x, y))[cls]


def key(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Four 16-bit taxon ids as one long; only for exchange with binary files, as its order is signed."""
    return F.shiftleft(a.cast("long"), 48).bitwiseOR(F.shiftleft(b.cast("long"), 32)).bitwiseOR(F.shiftleft(c.cast("long"), 16)).bitwiseOR(d.cast("long"))


def unkey(k: Column) -> list[Column]:
    """The four ids of a key."""
    return [F.shiftrightunsigned(k, n).bitwiseAND(F.lit(65535)).cast("int") for n in (48, 32, 16, 0)]


def softmax100(*x: Column) -> list[Column]:
    top = F.greatest(*x)
    parts = [F.exp(v - top) for v in x]
    total = sum(parts[1:], parts[0])
    return [100 * p / total for p in parts]


def top_class(*w: Column) -> Column:
    """The class of the largest weight, the lowest on ties."""
    top = F.greatest(*w)
    return F.when(w[0] == top, 0).when(w[1] == top, 1).otherwise(2)


def top1_only(*w: Column) -> list[Column]:
    """Weights with all but the first largest set to 0."""
    best = top_class(*w)
    return [F.when(best == k, v).otherwise(F.lit(0.0)) for k, v in enumerate(w)]


def guarded(*w: Column) -> list[Column]:
    """Rounded weights; where all would be 0 the largest class counts 1."""
    best, low = top_class(*w), F.greatest(*(F.rint(v) for v in w)) < 1
    return [F.when(low, (best == k).cast("long")).otherwise(F.rint(v).cast("long")) for k, v in enumerate(w)]


def rounded_mean(total: Column, n: Column) -> Column:
    """Mean rounded half to even; rounding to 9 places first keeps sums in another order from turning a tie."""
    return F.rint(F.round(total / n, 9)).cast("long")


def label(taxon: Column) -> Column:
    return F.concat(F.lit("t"), taxon.cast("string"))


def q1_support(name: Column) -> Column:
    """The number after q1= or _q1_ in a node name."""
    found = F.regexp_extract(name, r"(?:q1=|_q1_)([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)", 1)
    return F.when(found != "", found).try_cast("double")


def branch_info(info: Column, name: str) -> Column:
    """The value of name in key=value;key=value text, null if absent."""
    found = F.regexp_extract(info, rf"(?:^|[;\[]){name}=([^;\]]*)", 1)
    return F.when(found != "", found)


def number(text: Column) -> Column:
    """A number, or null where the text is none."""
    return F.trim(text).try_cast("double")


def flag(text: Column) -> Column:
    """A boolean from usual spellings, null for others."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("1", "true", "yes", "y", "on"), True).when(t.isin("0", "false", "no", "n", "off"), False)


def support01(support: Column, low: float, high: float) -> Column:
    """Support rescaled from [low, high] to [0, 1]; missing and out of range count as the least."""
    inside = support.isNotNull() & (support >= low) & (support <= high)
    return F.when(inside, (support - low) / (high - low)).otherwise(F.lit(0.0))


def length_weight(length: Column, weighting: str) -> Column:
    """exp(-length) in the modes that use lengths (h, l), else 1."""
    return F.exp(-F.coalesce(length, F.lit(0.0))) if weighting in ("h", "l") else F.lit(1.0)


def coalescent_length(q1: Column) -> Column:
    """Branch length in coalescent units from the main quartet frequency of gene trees: 0 up to a third, 9 for 1."""
    return F.when(q1 <= 1 / 3, F.lit(0.0)).when(q1 >= 1, F.lit(9.0)).otherwise(-F.log(1.5 * (1 - q1)))


def missing(character: Column) -> Column:
    return character.isin("?", "-", "N")
