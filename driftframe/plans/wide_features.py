"""Registered queries of the features by name, and the SQL of all their columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tracks, wide
from .features import FITTED
from .queries import BY, FRAMES, KEY, XYZ, query, segments

#: Series of a track in SQL: the prefix and end of its columns' names, and where its values come from.
SERIES = {"displ": ("displ_", "", "SELECT {by}, pt, step AS v FROM t WHERE step IS NOT NULL"), "angle": ("angle_", "", "SELECT {by}, pt, angle AS v FROM t WHERE angle IS NOT NULL")}
SERIES |= {c: ("displ_", f"_{c}", f"SELECT {{by}}, pt, abs(d{c}) AS v FROM t WHERE d{c} IS NOT NULL") for c in XYZ}
SERIES["dist"] = ("dist_", "", "SELECT {by}, pt, dist AS v FROM s")


def _sql(names: list[str], lags: int = 3) -> str:
    """Every column by windows, self-joins and groups over the frames in long form (series k, place pt, value v)."""
    series = [k for k, (p, e, _) in SERIES.items() if any(n.startswith(p) and n.endswith(e) for n in names)]
    by = f"{BY}, k"
    long = " UNION ALL ".join(f"SELECT {BY}, '{k}' AS k, pt, v FROM ({SERIES[k][2].format(by=BY)})" for k in SERIES)
    lagged = ", ".join(f"c * lag(c, {k}) OVER w AS p{k}" for k in range(1, lags + 1))
    sums = ", ".join(f"sum(p{k}) / sum(c * c) AS autocorr_{k}, avg(p{k}) / avg(c * c) AS r{k}" for k in range(1, lags + 1))
    sql = FRAMES + f""", v AS ({long}),
c AS (SELECT *, v - avg(v) OVER (PARTITION BY {by}) AS c, row_number() OVER (PARTITION BY {by} ORDER BY v, pt) AS r, row_number() OVER (PARTITION BY {by} ORDER BY pt) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n FROM v),
l AS (SELECT *, {lagged} FROM c WINDOW w AS (PARTITION BY {by} ORDER BY pt)),
m AS (SELECT {by}, sum(v) AS total, avg(v) AS average, max(v) AS maximum, min(v) AS minimum, max(v) - min(v) AS peak_to_peak, regr_slope(v, i) AS slope, sqrt(avg(v * v)) AS rms, max(abs(v)) AS peak,
  avg(c * c) AS variance, sqrt(avg(c * c)) / nullif(avg(v), 0) AS cov, avg(c * c * c) / nullif(avg(c * c) * sqrt(avg(c * c)), 0) AS skewness, avg(c * c * c * c) / nullif(avg(c * c) * avg(c * c), 0) - 3 AS kurtosis,
  avg(v * v * v * v) / nullif(3 * avg(v * v) * avg(v * v), 0) - 1 AS ngaussalpha, sum((2 * r - n - 1) * v) / nullif(max(n) * max(n) * avg(v), 0) AS gini, max(v) > min(v) AS varies, {sums} FROM l GROUP BY {by}),
q AS (SELECT *, maximum / nullif(rms, 0) AS crestfactor, rms / nullif(average, 0) AS formfactor, peak / nullif(average, 0) AS pulseindicator, r1 AS partial_autocorr_1, (r2 - r1 * r1) / nullif(1 - r1 * r1, 0) AS partial_autocorr_2,
  (r1 * r1 * r1 - 2 * r1 * r2 + r3 - r1 * r1 * r3 + r1 * r2 * r2) / nullif(1 - 2 * r1 * r1 + 2 * r1 * r1 * r2 - r2 * r2, 0) AS partial_autocorr_3 FROM m),
hb AS (SELECT *, i // w AS b FROM (SELECT *, n // (1 << h) AS w FROM (SELECT c.*, unnest(range(0, cast(floor(log2(n)) AS bigint) - 1)) AS h FROM c)) WHERE i // w < n // w),
hc AS (SELECT *, v - avg(v) OVER (PARTITION BY {by}, h, b) AS cc FROM hb), hy AS (SELECT *, sum(cc) OVER (PARTITION BY {by}, h, b ORDER BY i) AS y FROM hc),
hq AS (SELECT {by}, h, w, b, (max(y) - min(y)) / stddev_pop(v) AS rs FROM hy GROUP BY {by}, h, w, b HAVING stddev_pop(v) > 1e-12),
hu AS (SELECT {by}, regr_slope(ln(m), ln(w)) AS "hurst_RS" FROM (SELECT {by}, h, w, avg(rs) AS m FROM hq GROUP BY {by}, h, w) GROUP BY {by}),
pp AS (SELECT a."Type", a."Label", a.seg, b.pt - a.pt AS tau, avg((b.x - a.x) ** 2) AS x, avg((b.y - a.y) ** 2) AS y, avg((b.z - a.z) ** 2) AS z FROM s a JOIN s b ON a."Type" = b."Type" AND a."Label" = b."Label" AND a.seg = b.seg AND b.pt > a.pt GROUP BY 1, 2, 3, 4),
ends AS (SELECT {BY}, {', '.join(f'last({c} ORDER BY pt) - first({c} ORDER BY pt) AS n_{c}, max({c}) - min({c}) AS e_{c}' for c in XYZ)} FROM s GROUP BY {BY}),
ms AS (SELECT {BY}, {', '.join(f'max({e}) FILTER (WHERE tau = {k}) AS {n}_{k}' for n, e in (('msds', 'x + y + z'), *[(f'msd_{c}', c) for c in XYZ]) for k in range(1, lags + 1))},
  {', '.join(f'regr_slope(ln(nullif({e}, 0)), ln(tau)) AS {n}' for n, e in (('alphas', 'x + y + z'), *[(f'alpha_{c}', c) for c in XYZ]))} FROM pp GROUP BY {BY})
"""
    pick = lambda k, e: f"max(CASE WHEN q.k = '{k}' THEN {e} END)"
    whole = "sqrt(max(n_x * n_x + n_y * n_y + n_z * n_z))"
    made = {}
    for n in wide.ANGLES:
        of = {"total_angle": "total", "avg_angle": "average / 0.5", "max_angle": "maximum / 0.5", "min_angle": "minimum / 0.5"}[n]
        made[n] = pick("angle", of)
    for k, end, net in (("displ", "", whole), *[(c, f"_{c}", f"max(abs(n_{c}))") for c in XYZ]):
        made |= {f"total_distance{end}": pick(k, "total"), f"avg_speed{end}": pick(k, "average / 0.5"), f"max_speed{end}": pick(k, "maximum / 0.5"), f"min_speed{end}": pick(k, "minimum / 0.5"), f"net_distance{end}": net, f"progressivity{end}": f"{net} / nullif({pick(k, 'total')}, 0)"}
    for n in ("msds", *[f"msd_{c}" for c in XYZ]):
        made |= {f"{n}_{k}": f"max({n}_{k})" for k in range(1, lags + 1)}
    made |= {n: f"max({n})" for n in ("alphas", *[f"alpha_{c}" for c in XYZ])}
    for kind, of in (("max", lambda c: f"max(e_{c})"), ("total", lambda c: pick(c, "total"))):
        x, y, z = map(of, XYZ)
        made |= {f"exy_{kind}": f"{y} / {x}", f"eyz_{kind}": f"{z} / {y}", f"exz_{kind}": f"{z} / {x}", f"phi_{kind}": f"cbrt({z} * {z} / ({x} * {y}))"}
    for k, (p, e, _) in SERIES.items():
        for prop in wide.PROPERTIES:
            for end in [f"_{i}" for i in range(1, lags + 1)] if "autocorr" in prop else [""]:
                made[f"{p}{prop}{e}{end}"] = pick(k, prop + end if prop == "hurst_RS" else f"CASE WHEN varies THEN {prop}{end} END")
        if p == "dist_":
            made |= {f"{p}{prop}": pick(k, prop) for prop in wide.SIGNALS}
    columns = [c for n in names for c in ([f"{n}_{k}" for k in range(1, lags + 1)] if n.startswith("msd") or "autocorr" in n else [n])]
    key = KEY.replace('"Type"', 'q."Type"').replace('"Label"', 'q."Label"').replace("cast(seg", "cast(q.seg")
    return sql + f"SELECT {key}, " + ", ".join(f"round({made[c]}, 6) + 0.0::double AS \"{c}\"" for c in columns) + f""" FROM q LEFT JOIN hu USING ({by}) JOIN ends USING ({BY}) JOIN ms USING ({BY}) GROUP BY q."Type", q."Label", q.seg"""


WHOLE = [n for n in wide.known_names([])]
AXES = [n for n in wide.known_names(XYZ) if n not in WHOLE and not n.startswith("speed_distribution")]
SIGNAL = [n for n in wide.known_names([], ["dist"]) if n not in WHOLE]


@query("m11_features_by_name", _sql(WHOLE))
def _(s, d):
    return wide.features(segments(s, d), tracks.SEGMENT, "pt", XYZ, WHOLE)


@query("a8_axis_features", _sql(AXES))
def _(s, d):
    return wide.features(segments(s, d), tracks.SEGMENT, "pt", XYZ, AXES)


@query("g3_signal_features", _sql(SIGNAL))
def _(s, d):
    return wide.features(segments(s, d), tracks.SEGMENT, "pt", XYZ, SIGNAL, signals=["dist"])


@query("a4_speed_distributions", FRAMES + "SELECT " + KEY + ", " + ", ".join(f"string_agg(cast(round(abs(d{c}) / 0.5 * 1000) AS bigint), ',' ORDER BY pt) AS {c}" for c in XYZ) + f" FROM d GROUP BY {BY}")
def _(s, d):
    got = wide.features(segments(s, d), tracks.SEGMENT, "pt", XYZ, [f"speed_distribution_{c}" for c in XYZ])
    return got.select(*tracks.SEGMENT, *[F.array_join(F.transform(f"speed_distribution_{c}", lambda v: F.round(v * 1000).cast("long").cast("string")), ",").alias(c) for c in XYZ])


def _aligned(s, d):
    """All features of the tracks' own axes, but the arrays."""
    return wide.aligned_features(segments(s, d), tracks.SEGMENT, "pt", XYZ, AXES)


FITTED["a8_aligned_features"] = _aligned
