"""Group statistics."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .ordering import group_quantiles, running_before, same_keys, value_parts
from .rounds import Rounds


def shares(df: DataFrame, condition: str, cluster: str) -> DataFrame:
    """Percent of each cluster within its condition, 0 for pairs that do not occur, and its percent across conditions."""
    n = df.groupBy(condition, cluster).agg(F.count("*").alias("n"))
    grid = n.select(condition).distinct().join(n.select(cluster).distinct())  # groups, not rows
    n = grid.join(n, [condition, cluster], "left").fillna(0, ["n"])
    n = n.withColumn("share", 100 * F.col("n") / F.sum("n").over(W.partitionBy(condition)))
    return n.withColumn("relative_share", 100 * F.col("share") / F.nullif(F.sum("share").over(W.partitionBy(cluster)), F.lit(0.0)))


def cluster_entropy(df: DataFrame, condition: str, cluster: str) -> DataFrame:
    """Shannon entropy (ln) of the cluster shares of each condition and the largest possible."""
    n = df.groupBy(condition, cluster).agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy(condition)))
    top = df.agg(F.ln(F.count_distinct(cluster).cast("double")).alias("max_entropy"))
    return n.groupBy(condition).agg((-F.sum(F.col("p") * F.ln("p"))).alias("entropy")).join(F.broadcast(top))  # one row


def order_clusters(df: DataFrame, cluster: str, feature: str, by: str = "median") -> DataFrame:
    """(cluster, new_label): clusters numbered by ascending median (or mean) of the feature."""
    m = df.groupBy(cluster).agg(F.avg(feature).alias("__m"))
    if by == "median":
        m = same_keys(m.select(cluster), group_quantiles(df, [cluster], feature, {"__m": 0.5}), [cluster], "left")
    return m.withColumn("new_label", F.row_number().over(W.orderBy("__m", cluster)) - 1).drop("__m")


def cohen_d(df: DataFrame, group: str, x: str, one, two) -> DataFrame:
    """(mean of two - mean of one) over the pooled deviation, from population variances."""
    a, b = F.when(F.col(group) == one, F.col(x)), F.when(F.col(group) == two, F.col(x))
    pooled = F.sqrt(((F.count(a) - 1) * F.var_pop(a) + (F.count(b) - 1) * F.var_pop(b)) / (F.count(a) + F.count(b) - 2))
    return df.agg(((F.avg(b) - F.avg(a)) / F.nullif(pooled, F.lit(0.0))).alias("cohen_d"))


def mid_ranks(df: DataFrame, x: str, within: list[str] | None = None) -> DataFrame:
    """df with mid_rank and ties of x, overall or within groups: values are counted first, so ties cost one row, and ranked in parts."""
    within = within or []
    df = df.where(F.col(x).isNotNull())
    values = df.groupBy(*within, x).agg(F.count("*").alias("ties"))
    values = running_before(values, x, "ties", value_parts(df, x), within)
    return df.join(values.select(*within, x, "ties", (F.col("before") + (F.col("ties") + 1) / 2).alias("mid_rank")), [*within, x])


def _pair_ranks(df: DataFrame, group: str, x: str) -> DataFrame:
    """Per pair of groups: the rank sum w of the first, both sizes, and the sum of t^3 - t over tied values. Equal values of a group are counted before they meet the pairs."""
    g = df.select(F.col(group).alias("g"), F.col(x).alias("x")).where("g is not null and x is not null")
    part = value_parts(g, "x")
    g = g.groupBy("g", "x").agg(F.count("*").alias("n"))
    names = g.select("g").distinct()
    pairs = names.select(F.col("g").alias("one")).join(names.select(F.col("g").alias("two")), F.col("one") < F.col("two"))  # groups, not rows
    sides = pairs.withColumn("g", F.explode(F.array("one", "two")))
    v = g.join(sides, "g").groupBy("one", "two", "x").agg(F.sum(F.when(F.col("g") == F.col("one"), F.col("n")).otherwise(0)).alias("a"), F.sum("n").alias("ties"))
    r = running_before(v, "x", "ties", part, ["one", "two"])
    t = F.col("ties").cast("double")
    return r.groupBy("one", "two").agg(F.sum(F.col("a") * (F.col("before") + (F.col("ties") + 1) / 2)).alias("w"), F.sum("a").alias("n1"), F.sum(F.col("ties") - F.col("a")).alias("n2"), F.sum(t * t * t - t).alias("tied"))


def rank_tests(df: DataFrame, group: str, x: str) -> DataFrame:
    """Per pair of groups: Mann-Whitney U of the first, rank-sum z without corrections."""
    s = _pair_ranks(df, group, x)
    u = F.col("w") - F.col("n1") * (F.col("n1") + 1) / 2
    z = (F.col("w") - F.col("n1") * (F.col("n1") + F.col("n2") + 1) / 2) / F.sqrt(F.col("n1").cast("double") * F.col("n2") * (F.col("n1") + F.col("n2") + 1) / 12)
    return s.select("one", "two", u.alias("u"), z.alias("z"))


def mann_whitney(df: DataFrame, group: str, x: str) -> DataFrame:
    """Per pair of groups: U of the first, z corrected for ties and continuity, and its two-sided p (by the normal limit at every size); null where all values are equal."""
    s = _pair_ranks(df, group, x)
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n, u = n1 + n2, F.col("w") - n1 * (n1 + 1) / 2
    dev = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("tied") / (n * (n - 1))))
    z = (F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / F.nullif(dev, F.lit(0.0))
    return s.select("one", "two", u.alias("u"), z.alias("z")).withColumn("p", F.when(F.col("z") < 0, F.lit(1.0)).otherwise(two_sided_p("z")))


@F.pandas_udf(T.DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """P(|Z| >= |z|) of the normal distribution; a row per test. Null or not a number stays so."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)), na_action="ignore")


def _fraction(step: Callable[[int], tuple[float, float]], first: float) -> float:
    """The continued fraction first + a1 / (b1 + a2 / (b2 + ..)), step(k) = (ak, bk), by the modified Lentz method."""
    tiny = 1e-300
    out = c = first or tiny
    d = 0.0
    for k in range(1, 100_000):
        a, b = step(k)
        d = 1 / (b + a * d or tiny)
        c = b + a / c or tiny
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def gamma_tail(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-17:
            k += 1
            term *= x / k
            total += term
        return 1 - scale * total
    return scale / _fraction(lambda k: (-k * (k - a), x + 2 * k + 1 - a), x + 1 - a)


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function of x."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)

    def step(k: int) -> tuple[float, float]:
        m = k // 2
        even = m * (b - m) * x / ((a + k - 1) * (a + k))
        return (even if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + k - 1) * (a + k))), 1.0

    scale = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return scale / (a * _fraction(step, 1.0))


def _by_test(tail: Callable[..., float], *columns: pd.Series) -> pd.Series:
    return pd.Series([None if any(v is None or v != v for v in row) else tail(*row) for row in zip(*columns)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def chi_square_p(h: pd.Series, dof: pd.Series) -> pd.Series:
    """P(X >= h) of the chi-square distribution; a row per test, null where an argument is."""
    return _by_test(lambda h, d: gamma_tail(d / 2, h / 2), h, dof)


@F.pandas_udf(T.DoubleType())
def f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """P(X >= f) of the F distribution; as above."""
    return _by_test(lambda f, a, b: beta_share(b / 2, a / 2, b / (b + a * max(f, 0.0))), f, d1, d2)


@F.pandas_udf(T.DoubleType())
def t_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    """P(|X| >= |t|) of Student's distribution; as above."""
    return _by_test(lambda t, d: beta_share(d / 2, 0.5, d / (d + t * t)), t, dof)


def _normal_share(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.vectorize(math.erfc, otypes=[float])(-x / math.sqrt(2))


def _over_deviation(share: Callable[[float], float], dof: float, steps: int = 96) -> float:
    """Mean of share(s) over s, the ratio of an estimated deviation with `dof` degrees of freedom to the true one.

    By the trapezoid rule in ln s, where the density vanishes at both ends.
    """
    width = 1 / math.sqrt(2 * dof)
    at = np.linspace(-40 / dof - 8 * width, math.log1p(8 * width), max(2, steps if dof > 20 else 4 * steps))
    log = dof * at - dof * np.expm1(2 * at) / 2
    weight = np.exp(log - log.max())
    used = weight > 1e-17
    return float(np.dot(weight[used], [share(s) for s in np.exp(at[used])]) / weight[used].sum())


#: Places and weights of the trapezoid rule over a standard normal variable.
_AT = np.linspace(-8.5, 8.5, 137)
_MASS = np.exp(-_AT * _AT / 2) / np.exp(-_AT * _AT / 2).sum()
_BELOW = _normal_share(_AT)


def range_tail(q: float, groups: float, dof: float) -> float:
    """P(Q >= q) of the studentised range of `groups` means with `dof` degrees of freedom."""
    if q <= 0:
        return 1.0
    share = lambda s: groups * float(np.dot(_MASS, (_BELOW - _normal_share(_AT - q * s)) ** (groups - 1)))
    return min(1.0, max(0.0, 1 - _over_deviation(share, dof)))


def many_to_one_tail(t: float, sizes: list[float], control: float, dof: float) -> float:
    """P(max |T| >= |t|) of the differences of groups of the given sizes from one control of size `control`."""
    shared = np.sqrt(np.array(sizes) / (np.array(sizes) + control))  # the control's part of each difference
    own = np.sqrt(1 - shared**2)
    sizes_, times = np.unique(np.stack([shared, own], 1), axis=0, return_counts=True)

    def share(s: float) -> float:
        within = np.ones_like(_AT)
        for (lam, rest), n in zip(sizes_, times):
            within *= (_normal_share((lam * _AT + abs(t) * s) / rest) - _normal_share((lam * _AT - abs(t) * s) / rest)) ** n
        return float(np.dot(_MASS, within))

    return min(1.0, max(0.0, 1 - _over_deviation(share, dof)))


@F.pandas_udf(T.DoubleType())
def range_p(q: pd.Series, groups: pd.Series, dof: pd.Series) -> pd.Series:
    """P(Q >= q) of the studentised range; a row per test, null where an argument is."""
    return _by_test(range_tail, q, groups, dof)


@F.pandas_udf(T.DoubleType())
def many_to_one_p(t: pd.Series, sizes: pd.Series, control: pd.Series, dof: pd.Series) -> pd.Series:
    """The adjusted p of comparisons with one control, sizes being those of all groups but it; as above."""
    rows = zip(t, sizes, control, dof)
    return pd.Series([None if a is None or a != a or not d > 0 else many_to_one_tail(a, list(n), c, d) for a, n, c, d in rows], dtype="float64")


def welch_tests(df: DataFrame, group: str, x: str) -> DataFrame:
    """Per pair of groups: Welch's t (first less second) and its degrees of freedom, from one pass of moments; null where both deviate by 0."""
    m = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.avg(x).alias("m"), (F.var_samp(x) / F.count(x)).alias("v"), F.count(x).alias("n"))
    side = lambda k, name: m.select(F.col(group).alias(name), *[F.col(c).alias(f"{c}{k}") for c in "mvn"])
    v = F.col("v1") + F.col("v2")
    t = (F.col("m1") - F.col("m2")) / F.nullif(F.sqrt(v), F.lit(0.0))
    dof = v * v / F.nullif(F.col("v1") * F.col("v1") / (F.col("n1") - 1) + F.col("v2") * F.col("v2") / (F.col("n2") - 1), F.lit(0.0))
    return side(1, "one").join(side(2, "two"), F.col("one") < F.col("two")).select("one", "two", t.alias("t"), dof.alias("dof"))  # groups, not rows


def rank_sums(df: DataFrame, group: str, x: str) -> DataFrame:
    """(g, r, n, t) per group: the sum of its mid ranks among all, its size, and the sum of ties^2 - 1; null groups are one, null values left out.

    Equal values of a group are counted first. Values are ranked where their part is, and a part's own
    sums are moved by the rows of the parts below it, so that rows are exchanged by value and by part and
    never joined. The result, a row a group, is a written table: what is derived from it ranks nothing again.
    """
    s = df.select(F.col(group).alias("g"), F.col(x).alias("x")).where("x is not null")
    part = value_parts(s, "x")
    own = s.groupBy("g", "x").agg(F.count("*").alias("k")).withColumn("__part", part)
    values = W.partitionBy("__part").orderBy("x")
    own = own.withColumn("upto", F.sum("k").over(values.rangeBetween(W.unboundedPreceding, W.currentRow))).withColumn("ties", F.sum("k").over(W.partitionBy("__part", "x")))
    middle = F.col("upto") - (F.col("ties") - 1) / 2
    parts = own.groupBy("__part", "g").agg(F.sum(F.col("k") * middle).alias("r"), F.sum("k").alias("n"), F.sum(F.col("k") * (F.col("ties") * F.col("ties") - 1.0)).alias("t"))
    parts = Rounds(df.sparkSession).keep(parts, "parts")  # a row per group and part, as below
    sums = parts.groupBy("__part").agg(F.sum("n").alias("__n"))
    off = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    moved = parts.join(sums.select("__part", off.alias("__off")), "__part")
    return moved.groupBy("g").agg(F.sum(F.col("r") + F.col("__off") * F.col("n")).alias("r"), F.sum("n").alias("n"), F.sum("t").alias("t"))


def _kruskal_wallis(by: DataFrame) -> DataFrame:
    n = F.sum("n").cast("double")
    h = (12 / (n * (n + 1)) * F.sum(F.col("r") * F.col("r") / F.col("n")) - 3 * (n + 1)) / (1 - F.sum("t") / (n * n * n - n))
    return by.agg(h.alias("h"), (F.count("*") - 1).alias("dof"))


def kruskal_wallis(df: DataFrame, group: str, x: str) -> DataFrame:
    """H with the correction for ties; equal values of a group are counted first."""
    return _kruskal_wallis(rank_sums(df, group, x))


def _dunn(by: DataFrame) -> DataFrame:
    m = by.select("g", (F.col("r") / F.col("n")).alias("m"), F.col("n").cast("double").alias("n"), "t")
    n, t = F.col("all_n"), F.col("all_t")
    spread = m.agg(F.sum("n").alias("all_n"), F.sum("t").alias("all_t")).select((n * (n + 1) / 12 - t / (12 * (n - 1))).alias("spread"))
    side = lambda k, name: m.select(F.col("g").alias(name), F.col("m").alias(f"m{k}"), F.col("n").alias(f"n{k}"))
    pairs = side(1, "one").join(side(2, "two"), F.col("one") < F.col("two")).join(F.broadcast(spread))  # groups, not rows; one row
    z = (F.col("m1") - F.col("m2")) / F.nullif(F.sqrt(F.col("spread") * (1 / F.col("n1") + 1 / F.col("n2"))), F.lit(0.0))
    return pairs.select("one", "two", z.alias("z"))


def dunn(df: DataFrame, group: str, x: str) -> DataFrame:
    """Per pair of groups: z of the difference of mean ranks (first less second), corrected for ties; null where all values are equal."""
    return _dunn(rank_sums(df.where(F.col(group).isNotNull()), group, x))


def post_hoc(df: DataFrame, group: str, x: str, level: float = 0.05) -> DataFrame:
    """Dunn's test behind the omnibus one: per pair of groups z, p and the Benjamini-Hochberg adjusted p; no rows where Kruskal and Wallis' p is over `level`.

    Both take the same ranks. Rows without a group take part in neither.
    """
    by = rank_sums(df.where(F.col(group).isNotNull()), group, x)
    omnibus = _kruskal_wallis(by).withColumn("__p", chi_square_p("h", "dof")).select("__p")
    pairs = _dunn(by).withColumn("p", two_sided_p("z"))
    return adjust(pairs, "p", ["one", "two"]).join(F.broadcast(omnibus)).where(F.col("__p") <= level).drop("__p")  # one row


def anova(df: DataFrame, group: str, x: str) -> DataFrame:
    """F of the one-way analysis of variance and its degrees of freedom, between (d1) and within groups (d2); F is null for one group or where none deviates."""
    by = df.where(F.col(x).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v"))
    mean = by.agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("__mean"))
    by = by.join(F.broadcast(mean)).withColumn("off", F.col("m") - F.col("__mean"))  # one row
    between = F.sum(F.col("n") * F.col("off") * F.col("off"))
    f = F.try_divide(F.try_divide(between, F.count("*") - 1), F.try_divide(F.sum(F.col("n") * F.col("v")), F.sum("n") - F.count("*")))
    return by.agg(f.alias("f"), (F.count("*") - 1).alias("d1"), (F.sum("n") - F.count("*")).alias("d2"))


def _against_within(df: DataFrame, group: str, x: str, level: float) -> tuple[DataFrame, DataFrame]:
    """(g, m, n) of the groups, and one row (within, dof, groups) with the mean square within groups; none where the analysis of variance has p over `level`."""
    s = df.select(F.col(group).alias("g"), F.col(x).cast("double").alias("x")).where("g is not null and x is not null")
    m = s.groupBy("g").agg(F.avg("x").alias("m"), F.count("*").cast("double").alias("n"), F.var_pop("x").alias("v"))
    whole = m.agg((F.sum(F.col("n") * F.col("v")) / F.nullif(F.sum("n") - F.count("*"), F.lit(0.0))).alias("within"), (F.sum("n") - F.count("*")).alias("dof"), F.count("*").cast("double").alias("groups"))
    omnibus = anova(s, "g", "x").select(f_p(F.col("f"), F.col("d1").cast("double"), F.col("d2").cast("double")).alias("p"))
    return m.drop("v"), whole.join(F.broadcast(omnibus)).where(F.col("p") <= level).drop("p")  # one row


def tukey(df: DataFrame, group: str, x: str, level: float = 0.05) -> DataFrame:
    """Tukey's and Kramer's test behind the analysis of variance: per pair of groups the difference of means (first less second), q and p.

    p is that of the studentised range over all groups. No rows where the analysis of variance has p
    over `level`, for fewer than two groups, or where no group deviates. Null groups and values are left out.
    """
    m, whole = _against_within(df, group, x, level)
    side = lambda k, name: m.select(F.col("g").alias(name), F.col("m").alias(f"m{k}"), F.col("n").alias(f"n{k}"))
    pairs = side(1, "one").join(side(2, "two"), F.col("one") < F.col("two")).join(F.broadcast(whole))  # groups, not rows; one row
    off = F.col("m1") - F.col("m2")
    q = F.abs(off) / F.nullif(F.sqrt(F.col("within") / 2 * (1 / F.col("n1") + 1 / F.col("n2"))), F.lit(0.0))
    return pairs.select("one", "two", off.alias("difference"), q.alias("q"), "groups", "dof").withColumn("p", range_p("q", "groups", "dof")).drop("groups", "dof")


def dunnett(df: DataFrame, group: str, x: str, control, level: float = 0.05) -> DataFrame:
    """Dunnett's test behind the analysis of variance: per group but the control the difference of its mean from the control's, t and the adjusted p.

    Two-sided, over all groups together. Rows are left out as in `tukey`; a control without values gives none.
    """
    m, whole = _against_within(df, group, x, level)
    base = m.where(F.col("g") == control).select(F.col("m").alias("m0"), F.col("n").alias("n0"))
    rest = m.where(F.col("g") != control)
    sizes = rest.agg(F.collect_list("n").alias("sizes"))  # a number a group
    s = rest.join(F.broadcast(base)).join(F.broadcast(whole)).join(F.broadcast(sizes))  # one row each
    off = F.col("m") - F.col("m0")
    t = off / F.nullif(F.sqrt(F.col("within") * (1 / F.col("n") + 1 / F.col("n0"))), F.lit(0.0))
    return s.select("g", off.alias("difference"), t.alias("t"), "sizes", "n0", "dof").withColumn("p", many_to_one_p("t", "sizes", "n0", "dof")).drop("sizes", "n0", "dof")


def adjust(df: DataFrame, p: str, order: list[str], method: str = "bh", within: list[str] | None = None) -> DataFrame:
    """adjusted: Bonferroni (at most 1), or Benjamini-Hochberg step-up without a cap, over all tests or those of each group. One row per test.

    Tests are ranked in parts of their values, so that no task holds all tests of a group; null keys
    of `within` are a group, and a test without p is left out.
    """
    s = df.where(F.col(p).isNotNull()).withColumn("__k", F.struct(*within) if within else F.lit(0))
    if method == "bonferroni":
        n = s.groupBy("__k").agg(F.count("*").alias("__n"))
        return s.join(n if within else F.broadcast(n), "__k").withColumn("adjusted", F.least(F.lit(1.0), F.col(p) * F.col("__n"))).drop("__n", "__k")
    s = s.withColumn("__part", value_parts(df, p))
    part, group = W.partitionBy("__k", "__part"), W.partitionBy("__k")
    s = s.withColumn("__at", F.row_number().over(part.orderBy(p, *order)))
    sums = s.groupBy("__k", "__part").agg(F.count("*").alias("__n"))  # a row per part of a group, as below
    off = F.coalesce(F.sum("__n").over(group.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    s = s.join(sums.select("__k", "__part", off.alias("__off"), F.sum("__n").over(group).alias("__all")), ["__k", "__part"])
    s = s.withColumn("__q", F.col(p) * F.col("__all") / (F.col("__off") + F.col("__at")))
    later = F.min("__low").over(group.orderBy(F.desc("__part")).rowsBetween(W.unboundedPreceding, -1))
    lows = s.groupBy("__k", "__part").agg(F.min("__q").alias("__low")).select("__k", "__part", later.alias("__later"))
    own = F.min("__q").over(part.orderBy(F.desc("__at")))
    return s.withColumn("__own", own).join(lows, ["__k", "__part"]).withColumn("adjusted", F.least("__own", "__later")).drop("__k", "__part", "__at", "__off", "__all", "__q", "__own", "__later")


def transitions(df: DataFrame, keys: list[str], order: list[str], state: str) -> DataFrame:
    """Counts of (current, next) states inside each sequence."""
    nxt = F.lead(state).over(W.partitionBy(*keys).orderBy(*order))
    return df.select(F.col(state).alias("current"), nxt.alias("next")).where("current is not null and next is not null").groupBy("current", "next").agg(F.count("*").alias("n"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts, shares of each true class and overall accuracy."""
    n = df.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    n = n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(truth)))
    return n.withColumn("accuracy", F.sum(F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0)).over(W.partitionBy()) / F.sum("n").over(W.partitionBy()))


def average_z(df: DataFrame, group: str, x: str, reference) -> DataFrame:
    """Mean of (x - mean of the reference group) / its population deviation, per group."""
    ref = df.where(F.col(group) == reference).agg(F.avg(x).alias("__m"), F.stddev_pop(x).alias("__s"))
    return df.join(F.broadcast(ref)).groupBy(group).agg(F.avg((F.col(x) - F.col("__m")) / F.col("__s")).alias("avg_z"))  # one row


#: Terms of hypergeometric distributions that a task holds at once.
TERMS = 1 << 18


@F.pandas_udf(T.StructType([T.StructField("p_over", T.DoubleType()), T.StructField("p_under", T.DoubleType())]))
def _tails(n: pd.Series, k: pd.Series, draws: pd.Series, hits: pd.Series) -> pd.DataFrame:
    """Both tails of each row from the ratios of neighbouring terms, whose sum is 1; null where the sizes are impossible."""
    n, k, draws, hits = (c.to_numpy("float64") for c in (n, k, draws, hits))
    share = np.clip(k / np.maximum(n, 1), 0, 1)
    mean, reach = draws * share, 12 * np.sqrt(np.maximum(draws, 0) * share * (1 - share)) + 60
    low = np.maximum(np.maximum(0, draws + k - n), np.floor(mean - reach))
    long = np.minimum(np.minimum(draws, k), np.ceil(mean + reach)) - low
    over, under = np.full(len(n), np.nan), np.full(len(n), np.nan)
    order = np.flatnonzero(long >= 0)
    order = order[np.argsort(long[order], kind="stable")]
    while len(order):
        width = int(long[order[-1]]) + 1
        r, order = order[-max(1, TERMS // width) :], order[: -max(1, TERMS // width)]
        at = low[r, None] + np.arange(width)
        beyond = np.arange(width) > long[r, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.log((k[r, None] - at + 1) * (draws[r, None] - at + 1) / (at * ((n - k - draws)[r, None] + at)))
        step[:, 0] = 0
        log = np.where(beyond, -np.inf, np.cumsum(np.where(beyond, 0, step), axis=1))
        term = np.exp(log - log.max(axis=1, keepdims=True))
        term /= term.sum(axis=1, keepdims=True)
        over[r], under[r] = (term * (at >= hits[r, None])).sum(axis=1), (term * (at <= hits[r, None])).sum(axis=1)
    return pd.DataFrame({"p_over": over, "p_under": under})


def hypergeometric_tails(df: DataFrame, n: str, k: str, draws: str, hits: str) -> DataFrame:
    """df with p_over = P(X >= hits) and p_under = P(X <= hits) of `draws` from n with k marked.

    Terms are those within 12 deviations (and 60) of the mean, beyond which all together are under 1e-30;
    a task adds up some 262,144 of them at a time.
    """
    s = df.where(F.col(n).isNotNull() & F.col(k).isNotNull() & F.col(draws).isNotNull()).withColumn("__t", _tails(n, k, draws, hits))
    return s.select(*df.columns, F.col("__t.p_over").alias("p_over"), F.col("__t.p_under").alias("p_under"))


def enrichment(df: DataFrame, group: str, cls: str) -> DataFrame:
    """Enrichment and depletion of each class in each group: the exact limit of shuffling the classes."""
    hits = df.groupBy(group, cls).agg(F.count("*").alias("hits"))
    out = hits.withColumn("n", F.sum("hits").over(W.partitionBy())).withColumn("k", F.sum("hits").over(W.partitionBy(cls))).withColumn("draws", F.sum("hits").over(W.partitionBy(group)))
    return hypergeometric_tails(out, "n", "k", "draws", "hits")


def two_level_curve(df: DataFrame, condition: str, unit: str, x: str, y: str, start: float, step: float, end: float, least: int) -> DataFrame:
    """Means of each unit in its bins (with at least `least` rows), then mean and deviation over the units."""
    b = df.where((F.col(x) >= start) & (F.col(x) < end)).withColumn("bin", (start + F.floor((F.col(x) - start) / step) * step).cast("double"))
    per = b.groupBy(condition, unit, "bin").agg(F.avg(y).alias("__m"), F.count("*").alias("__n")).where(F.col("__n") >= least)
    return per.groupBy(condition, "bin").agg(F.avg("__m").alias("mean"), F.stddev_pop("__m").alias("std"), F.count("*").alias("units"))
