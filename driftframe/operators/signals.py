"""Features of one signal per track: shape, runs of states."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .ordering import same_keys
from .tracks import SEGMENT


def shape_features(df: DataFrame, x: str, keys: list[str] = SEGMENT, time: str = "pt") -> DataFrame:
    """total, maximum, peak_to_peak, slope, rms, crestfactor, formfactor, pulseindicator; all-zero signals give 0."""
    zero = F.max(F.abs(F.col(x))) == 0
    rms = F.sqrt(F.avg(F.col(x) * F.col(x)))
    ratio = lambda a, b: F.when(zero, 0.0).otherwise(a / F.nullif(b, F.lit(0.0)))
    return df.groupBy(*keys).agg(
        F.sum(x).alias("total"), F.max(x).alias("maximum"), (F.max(x) - F.min(x)).alias("peak_to_peak"), F.regr_slope(F.col(x), F.col(time).cast("double")).alias("slope"),
        rms.alias("rms"), ratio(F.max(x), rms).alias("crestfactor"), ratio(rms, F.avg(x)).alias("formfactor"), ratio(F.max(F.abs(F.col(x))), F.avg(x)).alias("pulseindicator"),
    )


def state_runs(df: DataFrame, state: Column, states: list[str], keys: list[str] = SEGMENT, time: str = "pt") -> DataFrame:
    """<state>_times (frames) and <state>_persistence (longest run) of each state, 0 if absent."""
    p = W.partitionBy(*keys)
    s = df.select(*keys, time, state.cast("string").alias("__s"))
    s = s.withColumn("__g", F.row_number().over(p.orderBy(time)) - F.row_number().over(W.partitionBy(*keys, "__s").orderBy(time)))
    runs = s.groupBy(*keys, "__s", "__g").agg(F.count("*").alias("__n"))
    return runs.groupBy(*keys).agg(*[c for v in states for c in (F.coalesce(F.sum(F.when(F.col("__s") == v, F.col("__n"))), F.lit(0)).alias(f"{v}_times"), F.coalesce(F.max(F.when(F.col("__s") == v, F.col("__n"))), F.lit(0)).alias(f"{v}_persistence"))])


def overlap_features(df: DataFrame, x: str, keys: list[str] = SEGMENT, time: str = "pt") -> DataFrame:
    """avg_overlap, overlap_slopes (by place in the track), and times and persistences of contact (above 0) and noncontact (0)."""
    s = df.withColumn("__i", F.row_number().over(W.partitionBy(*keys).orderBy(time)).cast("double"))
    shape = s.groupBy(*keys).agg(F.avg(x).alias("avg_overlap"), F.regr_slope(F.col(x), F.col("__i")).alias("overlap_slopes"))
    runs = state_runs(df, F.when(F.col(x) > 0, "contact").when(F.col(x) == 0, "noncontact").otherwise("none"), ["contact", "noncontact"], keys, time)
    names = {f"{k}_persistence": f"{k}_persistences" for k in ("contact", "noncontact")}
    return same_keys(shape, runs.withColumnsRenamed(names), keys)


def permutation_entropy(df: DataFrame, x: str, keys: list[str] = SEGMENT, time: str = "pt") -> DataFrame:
    """Shannon entropy (ln) of ordinal patterns of three values, earlier of ties first."""
    w = W.partitionBy(*keys).orderBy(time)
    s = df.select(*keys, F.lag(x, 2).over(w).alias("a"), F.lag(x, 1).over(w).alias("b"), F.col(x).alias("c")).where("a is not null and b is not null and c is not null")
    code = F.expr("int(a > b) * 4 + int(a > c) * 2 + int(b > c)")
    n = s.groupBy(*keys, code.alias("code")).agg(F.count("*").alias("n"))
    n = n.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy(*keys)))
    return n.groupBy(*keys).agg((-F.sum(F.col("p") * F.ln("p"))).alias("permutation_entropy"))


def moment_features(df: DataFrame, x: str, keys: list[str] = SEGMENT) -> DataFrame:
    """average, variance, cov, skewness, kurtosis, ngaussalpha; 0 for all-zero signals."""
    zero = F.max(F.abs(F.col(x))) == 0
    of = lambda c, n: F.when(zero, 0.0).otherwise(c).alias(n)
    fourth, second = F.avg(F.pow(F.col(x), F.lit(4))), F.avg(F.col(x) * F.col(x))
    return df.groupBy(*keys).agg(of(F.avg(x), "average"), of(F.var_pop(x), "variance"), of(F.stddev_pop(x) / F.nullif(F.avg(x), F.lit(0.0)), "cov"), of(F.skewness(x), "skewness"), of(F.kurtosis(x), "kurtosis"), of(fourth / F.nullif(3 * second * second, F.lit(0.0)) - 1, "ngaussalpha"))


def references(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Long form (.., ref, value) of several distance columns, so that all are aggregated in one pass."""
    pairs = F.array(*[F.struct(F.lit(r).alias("ref"), F.col(c).cast("double").alias("value")) for r, c in columns.items()])
    return df.withColumn("__e", F.explode(pairs)).select(*[c for c in df.columns if c not in ("ref", "value")], "__e.ref", "__e.value")


def sample_entropy(df: DataFrame, x: str, m: int = 2, r: float = 0.2, keys: list[str] = SEGMENT, time: str = "pt") -> DataFrame:
    """-ln(A / B): pairs of m-words within r deviations whose next values agree too; null without such pairs. Words meet only inside their track."""
    p = W.partitionBy(*keys)
    s = df.select(*keys, F.row_number().over(p.orderBy(time)).alias("__i"), (F.stddev_pop(x).over(p) * r).alias("__tol"), *[F.lead(x, k).over(p.orderBy(time)).alias(f"__v{k}") if k else F.col(x).alias("__v0") for k in range(m + 1)]).where(f"__v{m} is not null")
    pairs = s.alias("a").join(s.select(*keys, F.col("__i").alias("__j"), *[F.col(f"__v{k}").alias(f"__w{k}") for k in range(m + 1)]), keys).where("__i < __j")
    near = [F.abs(F.col(f"__v{k}") - F.col(f"__w{k}")) < F.col("__tol") for k in range(m + 1)]
    both = near[0]
    for e in near[1:m]:
        both = both & e
    n = pairs.groupBy(*keys).agg(F.count_if(both).alias("b"), F.count_if(both & near[m]).alias("a"))
    return n.select(*keys, F.when((F.col("a") > 0) & (F.col("b") > 0), -F.ln(F.col("a") / F.col("b"))).alias("sample_entropy"))


def increment_entropy(df: DataFrame, x: str, m: int = 3, levels: int = 4, keys: list[str] = SEGMENT, time: str = "pt") -> DataFrame:
    """Shannon entropy (ln) of m-words of signed increments, sizes cut to `levels` steps of their deviation."""
    w, p = W.partitionBy(*keys).orderBy(time), W.partitionBy(*keys)
    s = df.select(*keys, time, (F.col(x) - F.lag(x).over(w)).alias("__v")).where("__v is not null")
    s = s.withColumn("__s", F.stddev_pop("__v").over(p))
    size = F.when(F.col("__s") > 0, F.least(F.lit(levels), F.floor(F.abs(F.col("__v")) * levels / F.col("__s")).cast("int"))).otherwise(0)
    s = s.withColumn("__q", (F.signum("__v") * size).cast("int"))
    s = s.select(*keys, *[F.lag("__q", k).over(w).alias(f"__q{k}") for k in range(1, m)], F.col("__q").alias("__q0")).where(f"__q{m - 1} is not null")
    n = s.groupBy(*keys, *[f"__q{k}" for k in range(m)]).agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(p))
    return n.groupBy(*keys).agg((-F.sum(F.col("p") * F.ln("p"))).alias("increment_entropy"))


def _entropies(v: np.ndarray, m: int, r: float) -> tuple[float, float]:
    """Approximate entropy (words of m within r deviations, self included) and attention entropy (gaps between peaks and valleys)."""
    tol = r * v.std()

    def phi(k: int) -> float:
        words = np.lib.stride_tricks.sliding_window_view(v, k)
        near = np.abs(words[:, None] - words[None]).max(axis=2) <= tol
        return float(np.log(near.mean(axis=1)).mean())

    d = np.sign(np.diff(v))
    up, down = (np.flatnonzero((s * d[:-1] > 0) & (s * d[1:] < 0)) + 1 for s in (1, -1))
    gaps = [np.diff(up), np.diff(down)] + [b[i[ok]] - a[ok] for a, b in ((up, down), (down, up)) for i in [np.searchsorted(b, a)] for ok in [i < len(b)]]
    shares = [np.unique(g, return_counts=True)[1] / len(g) for g in gaps if len(g)]
    return phi(m) - phi(m + 1), sum(float(-(p * np.log(p)).sum()) for p in shares) / 4


def entropies(df: DataFrame, x: str, m: int = 3, r: float = 0.2, keys: list[str] = SEGMENT, time: str = "pt") -> DataFrame:
    """approximate_entropy and attention_entropy of each track; both null for constant or short series or with missing values."""
    series = df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(time, F.coalesce(F.col(x).cast("double"), F.lit(float("nan"))).alias("v")))), lambda s: s["v"]).alias("v"))  # a track's frames

    @F.pandas_udf("approximate_entropy double, attention_entropy double")
    def of(v: pd.Series) -> pd.DataFrame:
        ok = lambda a: len(a) > m + 1 and np.isfinite(a).all() and a.std() > 0
        return pd.DataFrame([_entropies(a, m, r) if ok(a) else (None, None) for a in (np.asarray(s, float) for s in v)], columns=["approximate_entropy", "attention_entropy"], dtype=float)

    out = series.select(*keys, of("v").alias("e"))
    return out.select(*keys, *[F.nanvl(F.col(f"e.{c}"), F.lit(None)).alias(c) for c in ("approximate_entropy", "attention_entropy")])


def bubble_entropy(df: DataFrame, x: str, m: int = 3, keys: list[str] = SEGMENT, time: str = "pt") -> DataFrame:
    """Growth of the collision entropy of swaps that sort words of m and m + 1 values, over ln((m + 1) / (m - 1)); null without m + 1 values."""
    w = W.partitionBy(*keys).orderBy(time)
    s = df.where(F.col(x).isNotNull()).select(*keys, *[F.lag(x, m - k).over(w).alias(f"__v{k}") if k < m else F.col(x).alias(f"__v{k}") for k in range(m + 1)])
    swaps = lambda lo: sum((F.when(F.col(f"__v{i}") > F.col(f"__v{j}"), 1).otherwise(0) for i in range(lo, m + 1) for j in range(i + 1, m + 1)), F.lit(0))
    words = F.array(F.struct(F.lit(m).alias("k"), swaps(1).alias("s"), F.col("__v1").isNotNull().alias("ok")), F.struct(F.lit(m + 1).alias("k"), swaps(0).alias("s"), F.col("__v0").isNotNull().alias("ok")))
    n = s.select(*keys, F.inline(words)).where("ok").groupBy(*keys, "k", "s").agg(F.count("*").alias("n"))
    n = n.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy(*keys, "k")))
    h = lambda k: -F.ln(F.sum(F.when(F.col("k") == k, F.col("p") * F.col("p"))))
    return n.groupBy(*keys).agg(((h(m + 1) - h(m)) / math.log((m + 1) / (m - 1))).alias("bubble_entropy"))


def cosine_entropy(df: DataFrame, x: str, m: int = 3, r: float = 0.1, keys: list[str] = SEGMENT, time: str = "pt") -> DataFrame:
    """Entropy (ln) of the share of pairs of m-words with an angle below r half turns; 0 if none or all. Words meet only inside their track."""
    p = W.partitionBy(*keys)
    s = df.where(F.col(x).isNotNull()).select(*keys, F.row_number().over(p.orderBy(time)).alias("__i"), *[(F.lead(x, k).over(p.orderBy(time)) if k else F.col(x)).cast("double").alias(f"__v{k}") for k in range(m)]).where(f"__v{m - 1} is not null")
    dot = lambda a, b: sum((F.col(f"{a}{k}") * F.col(f"{b}{k}") for k in range(1, m)), F.col(f"{a}0") * F.col(f"{b}0"))
    s = s.withColumn("__size", F.sqrt(dot("__v", "__v")))
    pairs = s.join(s.select(*keys, F.col("__i").alias("__j"), F.col("__size").alias("__other"), *[F.col(f"__v{k}").alias(f"__w{k}") for k in range(m)]), keys).where("__i < __j")
    cos = dot("__v", "__w") / F.nullif(F.col("__size") * F.col("__other"), F.lit(0.0))
    share = F.count_if(F.coalesce(cos, F.lit(-2.0)) > math.cos(math.pi * r)) / F.count("*")
    n = pairs.groupBy(*keys).agg(share.alias("b"))
    b = F.col("b")
    return n.select(*keys, F.when((b > 0) & (b < 1), -b * F.ln(b) - (1 - b) * F.ln(1 - b)).otherwise(0.0).alias("cosine_entropy"))


def dispersion_entropy(df: DataFrame, x: str, m: int = 3, c: int = 3, keys: list[str] = SEGMENT, time: str = "pt") -> DataFrame:
    """Shannon entropy (ln) of m-words of classes: values cut at the c-quantiles of the normal distribution with the track's mean and population deviation; null where that is 0."""
    p = W.partitionBy(*keys)
    cuts = [NormalDist().inv_cdf(k / c) for k in range(1, c)]
    s = df.where(F.col(x).isNotNull()).select(*keys, time, ((F.col(x) - F.avg(x).over(p)) / F.nullif(F.stddev_pop(x).over(p), F.lit(0.0))).alias("__z"))
    s = s.where("__z is not null").withColumn("__c", sum((F.when(F.col("__z") >= k, 1).otherwise(0) for k in cuts), F.lit(0)))
    s = s.select(*keys, *[F.lead("__c", k).over(p.orderBy(time)).alias(f"__c{k}") if k else F.col("__c").alias("__c0") for k in range(m)]).where(f"__c{m - 1} is not null")
    n = s.groupBy(*keys, *[f"__c{k}" for k in range(m)]).agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(p))
    return n.groupBy(*keys).agg((-F.sum(F.col("p") * F.ln("p"))).alias("dispersion_entropy"))
