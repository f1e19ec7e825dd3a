"""§2.15 distribution-statistics queries (histograms, CDF curves, KDE, cut points, Kaplan-Meier)."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayflow.operators import stats as ST
from assayflow.plans.inputs import Tables
from assayflow.plans.q_functions import _erf_sql
from assayflow.plans.q_metrics import r6
from assayflow.plans.registry import query


@query("hist_frequency", """WITH b AS (SELECT l_returnflag, min(l_extendedprice) AS mn, max(l_extendedprice) AS mx, (max(l_extendedprice) - min(l_extendedprice)) / 10.0 AS w FROM lineitem GROUP BY 1),
c AS (SELECT l.l_returnflag, least(CAST(floor((l_extendedprice - mn) / w) AS INTEGER), 9) AS bin, count(*) AS c FROM lineitem l JOIN b ON l.l_returnflag = b.l_returnflag GROUP BY ALL),
g AS (SELECT l_returnflag, w, CAST(bin AS INTEGER) AS bin FROM b, range(0, 10) t(bin))
SELECT g.l_returnflag, g.bin, CAST(coalesce(c.c, 0) AS DOUBLE) AS count, round(coalesce(c.c, 0) / (sum(coalesce(c.c, 0)) OVER (PARTITION BY g.l_returnflag) * w), 12) AS density
FROM g LEFT JOIN c ON g.l_returnflag = c.l_returnflag AND g.bin = c.bin""")
def q_hist(spark, sf):
    li = Tables(spark, sf).lineitem
    a = ST.frequency(li, ["l_returnflag"], "l_extendedprice", 10)
    d = ST.frequency(li, ["l_returnflag"], "l_extendedprice", 10, normalize=True).withColumnRenamed("count", "density")
    return a.join(d, ["l_returnflag", "bin"]).select("l_returnflag", "bin", "count", F.round("density", 12).alias("density"))


@query("hist_bounds_norm", """SELECT o_orderkey, round((o_totalprice - min(o_totalprice) OVER w) / (max(o_totalprice) OVER w - min(o_totalprice) OVER w), 6) AS z
FROM orders WINDOW w AS (PARTITION BY o_orderpriority)""")
def q_bounds_norm(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderkey", "o_orderpriority", "o_totalprice")
    return ST.normalize_range(o, ["o_orderpriority"], "o_totalprice", "z").select("o_orderkey", r6(F.col("z")).alias("z"))


CDF_SQL = """c AS (SELECT o_orderpriority, row_number() OVER w AS point, (o_totalprice - min(o_totalprice) OVER p) / (max(o_totalprice) OVER p - min(o_totalprice) OVER p) AS x,
  sum(o_totalprice) OVER (w ROWS UNBOUNDED PRECEDING) / sum(o_totalprice) OVER p AS y FROM orders
  WINDOW p AS (PARTITION BY o_orderpriority), w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey)
  UNION ALL SELECT o_orderpriority, 0, (0 - min(o_totalprice)) / (max(o_totalprice) - min(o_totalprice)), 0.0 FROM orders GROUP BY 1)"""


@query("win_ecdf", f"WITH {CDF_SQL} SELECT o_orderpriority, point, round(x, 6) AS x, round(y, 6) AS y FROM c")
def q_ecdf(spark, sf):
    o = Tables(spark, sf).orders
    c = ST.value_cdf(o, ["o_orderpriority"], "o_totalprice", "o_orderkey")
    return c.select("o_orderpriority", "point", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query("win_step_cdf", f"""WITH {CDF_SQL}, s AS (SELECT *, lag(y) OVER (PARTITION BY o_orderpriority ORDER BY point) AS py FROM c)
SELECT o_orderpriority, point, 0 AS k, round(x, 6) AS x, round(py, 6) AS y FROM s WHERE py IS NOT NULL
UNION ALL SELECT o_orderpriority, point, 1, round(x, 6), round(y, 6) FROM s WHERE py IS NOT NULL""")
def q_step_cdf(spark, sf):
    o = Tables(spark, sf).orders
    c = ST.value_cdf(o, ["o_orderpriority"], "o_totalprice", "o_orderkey")
    s = ST.step_cdf(c, ["o_orderpriority"])
    return s.select("o_orderpriority", "point", "k", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


def _phi(u):
    return f"(exp(-0.5 * ({u}) * ({u})) / sqrt(2 * pi()))"


KDE_SQL = f"""p AS (SELECT event_type, count(value) AS n, min(value) AS mn, max(value) AS mx, 1.06 * stddev_samp(value) * power(count(value), -0.2) AS h FROM events GROUP BY 1),
g AS (SELECT event_type, i, mn + i * (mx - mn) / 99.0 AS x, h FROM p, range(0, 100) t(i)),
kd AS (SELECT g.event_type, g.i, g.x, avg({_phi('(g.x - e.value) / g.h')} / g.h) AS density,
  avg(-((g.x - e.value) / g.h) * {_phi('(g.x - e.value) / g.h')} / (g.h * g.h)) AS d1,
  avg(((g.x - e.value) / g.h * (g.x - e.value) / g.h - 1) * {_phi('(g.x - e.value) / g.h')} / (g.h * g.h * g.h)) AS d2,
  avg(0.5 * (1.0 + {_erf_sql('((g.x - e.value) / g.h / sqrt(2.0))')})) AS cdf
  FROM g JOIN events e ON g.event_type = e.event_type GROUP BY ALL)"""


def _kde(spark, sf):
    return ST.kde_grid(Tables(spark, sf).events, ["event_type"], "value")


@query("kde_fixed", f"WITH {KDE_SQL} SELECT event_type, CAST(i AS INTEGER) AS i, round(x, 6) AS x, round(density, 8) AS density, round(d1, 8) AS d1, round(d2, 8) AS d2, round(cdf, 6) AS cdf FROM kd")
def q_kde_fixed(spark, sf):
    k = _kde(spark, sf)
    return k.select("event_type", "i", r6(F.col("x")).alias("x"), *[F.round(c, 8).alias(c) for c in ("density", "d1", "d2")], r6(F.col("cdf")).alias("cdf"))


@query("kde_proportion", f"WITH {KDE_SQL} SELECT event_type, CAST(i AS INTEGER) AS i, round(CASE WHEN cdf > 0.5 THEN 1 - cdf ELSE cdf END, 6) AS proportion FROM kd")
def q_kde_proportion(spark, sf):
    return _kde(spark, sf).select("event_type", "i", r6(ST.proportion(F.col("cdf"))).alias("proportion"))


@query("kde_quantile", f"""WITH {KDE_SQL}, s AS (SELECT *, lead(x) OVER w AS nx, lead(cdf) OVER w AS nc FROM kd WINDOW w AS (PARTITION BY event_type ORDER BY i))
SELECT event_type, round(arg_min(x + (0.5 - cdf) * (nx - x) / (nc - cdf), i), 4) AS median FROM s WHERE cdf <= 0.5 AND nc >= 0.5 AND nc > cdf GROUP BY 1""")
def q_kde_quantile(spark, sf):
    q = ST.invert_cdf(_kde(spark, sf), ["event_type"], 0.5, "median")
    return q.select("event_type", F.round("median", 4).alias("median"))


DERIV_SQL = f"""{KDE_SQL}, s AS (SELECT *, lag(d1) OVER w AS p1, lag(d2) OVER w AS p2 FROM kd WINDOW w AS (PARTITION BY event_type ORDER BY i)),
pts AS (SELECT event_type, i, x, density AS y, 'Minimum' AS point_type FROM s WHERE p1 IS NOT NULL AND d1 >= 0 AND p1 < 0
  UNION ALL SELECT event_type, i, x, density, 'Maximum' FROM s WHERE p1 IS NOT NULL AND d1 <= 0 AND p1 > 0
  UNION ALL SELECT event_type, i, x, density, 'InflectionPoint' FROM s WHERE p1 IS NOT NULL AND ((d2 >= 0 AND p2 < 0) OR (d2 <= 0 AND p2 > 0)))"""


@query("win_sign_change", f"WITH {DERIV_SQL} SELECT event_type, CAST(i AS INTEGER) AS i, point_type FROM pts")
def q_sign_change(spark, sf):
    return ST.derivative_points(_kde(spark, sf), ["event_type"]).select("event_type", "i", "point_type")


@query("win_min_between_max", f"""WITH {DERIV_SQL}, e AS (SELECT *, lag(point_type) OVER w AS pt, lead(point_type) OVER w AS nt FROM pts
  WHERE point_type IN ('Minimum', 'Maximum') WINDOW w AS (PARTITION BY event_type ORDER BY x, point_type))
SELECT event_type, CAST(i AS INTEGER) AS i FROM e WHERE point_type = 'Minimum' AND pt = 'Maximum' AND nt = 'Maximum'""")
def q_min_between_max(spark, sf):
    pts = ST.derivative_points(_kde(spark, sf), ["event_type"])
    return ST.minima_between_maxima(pts, ["event_type"]).select("event_type", "i")


@query("win_inflection_pairs", f"""WITH {DERIV_SQL}, e AS (SELECT *, lead(point_type) OVER w AS nt FROM pts WINDOW w AS (PARTITION BY event_type ORDER BY x, point_type))
SELECT event_type, CAST(i AS INTEGER) AS i FROM e WHERE point_type = 'InflectionPoint' AND nt = 'InflectionPoint'""")
def q_inflection_pairs(spark, sf):
    pts = ST.derivative_points(_kde(spark, sf), ["event_type"])
    return ST.inflection_pairs(pts, ["event_type"]).select("event_type", "i")


ADAPTIVE_SQL = f"""WITH p AS (SELECT event_type, count(value) AS n, min(value) AS mn, max(value) AS mx, 1.06 * stddev_samp(value) * power(count(value), -0.2) AS h FROM events GROUP BY 1),
s AS (SELECT e.event_type, e.value, (mx - mn) / 1023.0 AS sp, mn, mx, n, h FROM events e JOIN p ON e.event_type = p.event_type),
s2 AS (SELECT *, CASE WHEN sp > 0 THEN (value - mn) / sp ELSE 0.0 END AS pos FROM s),
s3 AS (SELECT *, least(CAST(floor(pos) AS INTEGER), 1022) AS lo FROM s2),
s4 AS (SELECT *, pos - lo AS t FROM s3),
bins AS (SELECT event_type, b, sum(w) AS w FROM (SELECT event_type, lo AS b, 1 - t AS w FROM s4 UNION ALL SELECT event_type, lo + 1, t FROM s4) GROUP BY ALL),
q AS (SELECT DISTINCT event_type, sp, n, h FROM s),
pil AS (SELECT bins.event_type, i, sum(w * {_phi('(i - b) * q.sp / q.h')}) / (any_value(q.n) * any_value(q.h)) AS dens
  FROM bins JOIN q ON bins.event_type = q.event_type, range(0, 1024) t(i) GROUP BY bins.event_type, i),
bw AS (SELECT s4.event_type, s4.value, s4.h / ((d0.dens + s4.t * (d1.dens - d0.dens)) * s4.n) AS b, s4.h FROM s4
  JOIN pil d0 ON d0.event_type = s4.event_type AND d0.i = s4.lo JOIN pil d1 ON d1.event_type = s4.event_type AND d1.i = s4.lo + 1),
gm AS (SELECT event_type, exp(avg(ln(b))) AS gm FROM bw GROUP BY 1),
bw2 AS (SELECT bw.event_type, value, b * h / gm AS bandwidth FROM bw JOIN gm ON bw.event_type = gm.event_type),
grid AS (SELECT event_type, i, mn + i * (mx - mn) / 99.0 AS x FROM p, range(0, 100) t(i)),
kd AS (SELECT g.event_type, g.i, g.x, avg({_phi('(g.x - bw2.value) / bw2.bandwidth')} / bw2.bandwidth) AS density,
  avg(0.5 * (1.0 + {_erf_sql('((g.x - bw2.value) / bw2.bandwidth / sqrt(2.0))')})) AS cdf FROM grid g JOIN bw2 ON g.event_type = bw2.event_type GROUP BY ALL)
SELECT event_type, CAST(i AS INTEGER) AS i, round(x, 6) AS x, round(density, 8) AS density, round(cdf, 6) AS cdf FROM kd"""


@query("kde_adaptive", ADAPTIVE_SQL)
def q_kde_adaptive(spark, sf):
    """Adaptive-bandwidth KDE grid per event type (binned pilot density on a fine grid; brute-force check in tests)."""
    g = ST.kde_adaptive_grid(Tables(spark, sf).events, ["event_type"], "value")
    return g.select("event_type", "i", r6(F.col("x")).alias("x"), F.round("density", 8).alias("density"), r6(F.col("cdf")).alias("cdf"))


def _adaptive_ctes(src: str) -> str:
    """Adaptive KDE CTEs over ``src`` (columns g, value): bandwidths bw2(g, value, bandwidth), grid kd(g, i, x, density, d1, d2, cdf)."""
    phi = _phi
    return f"""p AS (SELECT g, count(value) AS n, min(value) AS mn, max(value) AS mx, 1.06 * stddev_samp(value) * power(count(value), -0.2) AS h FROM {src} GROUP BY 1),
s AS (SELECT e.g, e.value, (mx - mn) / 1023.0 AS sp, mn, mx, n, h FROM {src} e JOIN p ON e.g = p.g),
s2 AS (SELECT *, CASE WHEN sp > 0 THEN (value - mn) / sp ELSE 0.0 END AS pos FROM s),
s3 AS (SELECT *, least(CAST(floor(pos) AS INTEGER), 1022) AS lo FROM s2),
s4 AS (SELECT *, pos - lo AS t FROM s3),
bins AS (SELECT g, b, sum(w) AS w FROM (SELECT g, lo AS b, 1 - t AS w FROM s4 UNION ALL SELECT g, lo + 1, t FROM s4) GROUP BY ALL),
q AS (SELECT DISTINCT g, sp, n, h FROM s),
pil AS (SELECT bins.g, i, sum(w * {phi('(i - b) * q.sp / q.h')}) / (any_value(q.n) * any_value(q.h)) AS dens
  FROM bins JOIN q ON bins.g = q.g, range(0, 1024) t(i) GROUP BY bins.g, i),
bw AS (SELECT s4.g, s4.value, s4.h / ((d0.dens + s4.t * (d1.dens - d0.dens)) * s4.n) AS b, s4.h FROM s4
  JOIN pil d0 ON d0.g = s4.g AND d0.i = s4.lo JOIN pil d1 ON d1.g = s4.g AND d1.i = s4.lo + 1),
gm AS (SELECT g, exp(avg(ln(b))) AS gm FROM bw GROUP BY 1),
bw2 AS (SELECT bw.g, value, b * h / gm AS bandwidth FROM bw JOIN gm ON bw.g = gm.g),
grid AS (SELECT g, i, mn + i * (mx - mn) / 99.0 AS x FROM p, range(0, 100) t(i)),
kd AS (SELECT gr.g, gr.i, gr.x, avg({phi('(gr.x - bw2.value) / bw2.bandwidth')} / bw2.bandwidth) AS density,
  avg(-((gr.x - bw2.value) / bw2.bandwidth) * {phi('(gr.x - bw2.value) / bw2.bandwidth')} / (bw2.bandwidth * bw2.bandwidth)) AS d1,
  avg(((gr.x - bw2.value) / bw2.bandwidth * (gr.x - bw2.value) / bw2.bandwidth - 1) * {phi('(gr.x - bw2.value) / bw2.bandwidth')} / (bw2.bandwidth * bw2.bandwidth * bw2.bandwidth)) AS d2,
  avg(0.5 * (1.0 + {_erf_sql('((gr.x - bw2.value) / bw2.bandwidth / sqrt(2.0))')})) AS cdf FROM grid gr JOIN bw2 ON gr.g = bw2.g GROUP BY ALL)"""


def _invert_sql(name: str, target: str) -> str:
    return f"""{name} AS (SELECT g, arg_min(x + ({target} - cdf) * (nx - x) / (nc - cdf), i) AS xv FROM
  (SELECT k.*, lead(x) OVER w AS nx, lead(cdf) OVER w AS nc, sk.skew FROM kd k JOIN sk ON k.g = sk.g WINDOW w AS (PARTITION BY k.g ORDER BY i))
  WHERE cdf <= {target} AND nc >= {target} AND nc > cdf GROUP BY g)"""


CUT_SQL = f"""WITH raw AS (SELECT o_orderpriority AS g, o_totalprice AS v FROM orders),
rb AS (SELECT g, min(v) AS rmn, max(v) AS rmx FROM raw GROUP BY 1),
nz AS (SELECT raw.g, (v - rmn) / (rmx - rmn) AS value FROM raw JOIN rb ON raw.g = rb.g),
{_adaptive_ctes('nz')},
sk AS (SELECT g, sum(power(v - mu, 3)) / n / power(sum(power(v - mu, 2)) / n, 1.5) * sqrt(n * (n - 1)) / (n - 2) AS skew
  FROM (SELECT g, v, avg(v) OVER (PARTITION BY g) AS mu, count(*) OVER (PARTITION BY g) AS n FROM raw) GROUP BY g, n),
lg AS (SELECT *, lag(d1) OVER (PARTITION BY g ORDER BY i) AS p1, lag(d2) OVER (PARTITION BY g ORDER BY i) AS p2 FROM kd),
pts AS (SELECT g, i, x, density AS y, cdf, 'Minimum' AS pt FROM lg WHERE p1 IS NOT NULL AND d1 >= 0 AND p1 < 0
  UNION ALL SELECT g, i, x, density, cdf, 'Maximum' FROM lg WHERE p1 IS NOT NULL AND d1 <= 0 AND p1 > 0
  UNION ALL SELECT g, i, x, density, cdf, 'InflectionPoint' FROM lg WHERE p1 IS NOT NULL AND ((d2 >= 0 AND p2 < 0) OR (d2 <= 0 AND p2 > 0))),
ext AS (SELECT *, lag(pt) OVER w AS ppt, lag(y) OVER w AS py, lead(pt) OVER w AS npt, lead(y) OVER w AS ny FROM pts WHERE pt IN ('Minimum', 'Maximum')
  WINDOW w AS (PARTITION BY g ORDER BY x, pt)),
c1 AS (SELECT g, arg_min(x, x) AS x1, arg_min(CASE WHEN cdf >= 0.5 THEN 'UP' ELSE 'DOWN' END, x) AS dir1 FROM ext
  WHERE pt = 'Minimum' AND ppt = 'Maximum' AND npt = 'Maximum' AND least(cdf, 1 - cdf) >= 0.20 AND greatest(py - y, ny - y) >= 0.15 GROUP BY g),
ip AS (SELECT *, lead(pt) OVER w AS npt, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM pts WINDOW w AS (PARTITION BY g ORDER BY x, pt)),
pairs AS (SELECT g, x, (x + nx) / 2 AS xm, abs((y - ny) / (x - nx)) AS grad FROM ip WHERE pt = 'InflectionPoint' AND npt = 'InflectionPoint'),
pc AS (SELECT pairs.g, pairs.x, pairs.xm, pairs.grad, avg(0.5 * (1.0 + {_erf_sql('((pairs.xm - bw2.value) / bw2.bandwidth / sqrt(2.0))')})) AS cm
  FROM pairs JOIN bw2 ON pairs.g = bw2.g GROUP BY ALL),
c2 AS (SELECT g, arg_min(xm, x) AS x2, arg_min(CASE WHEN cm >= 0.5 THEN 'UP' ELSE 'DOWN' END, x) AS dir2 FROM pc
  WHERE least(cm, 1 - cm) >= 0.20 AND grad <= 5.0 GROUP BY g),
{_invert_sql('c3', "CASE WHEN skew >= 0 THEN 1.0 - 0.333 ELSE 0.333 END")}
SELECT rb.g AS o_orderpriority, CASE WHEN c1.x1 IS NOT NULL THEN 'Minimum' WHEN c2.x2 IS NOT NULL THEN 'Inflection' ELSE 'Proportion' END AS point_type,
  round(rmn + coalesce(c1.x1, c2.x2, c3.xv) * (rmx - rmn), 2) AS cut,
  coalesce(c1.dir1, c2.dir2, CASE WHEN sk.skew >= 0 THEN 'UP' ELSE 'DOWN' END) AS direction
FROM rb JOIN sk ON rb.g = sk.g LEFT JOIN c1 ON rb.g = c1.g LEFT JOIN c2 ON rb.g = c2.g LEFT JOIN c3 ON rb.g = c3.g"""


@query("kde_cut_point", CUT_SQL)
def q_cut_point(spark, sf):
    """Classification cut point of each order priority's total-price distribution."""
    c = ST.cut_point(Tables(spark, sf).orders, ["o_orderpriority"], "o_totalprice")
    return c.select("o_orderpriority", "point_type", F.round("cut", 2).alias("cut"), "direction")


CENSORED_SQL = "cz AS (SELECT event_type, CASE WHEN value < 2 THEN 2.0 ELSE round(value, 0) END AS v, CASE WHEN value < 2 THEN '<' ELSE '=' END AS m FROM events)"


def _censored(spark, sf):
    e = Tables(spark, sf).events
    return e.select("event_type", F.when(F.col("value") < 2, F.lit(2.0)).otherwise(F.round("value", 0)).alias("v"),
                    F.when(F.col("value") < 2, F.lit("<")).otherwise(F.lit("=")).alias("m"))


KM_SQL = f"""{CENSORED_SQL},
pv AS (SELECT event_type, v, count(*) AS c, count(*) FILTER (WHERE m = '=') AS exact FROM cz GROUP BY ALL),
n AS (SELECT event_type, count(*) AS n FROM cz GROUP BY 1),
t AS (SELECT pv.event_type, v, exact, CAST(n.n - coalesce(sum(c) OVER (PARTITION BY pv.event_type ORDER BY v DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS total, n.n
  FROM pv JOIN n ON pv.event_type = n.event_type),
e AS (SELECT *, (total - exact) / total AS r FROM t WHERE exact > 0),
f AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY v DESC) - 1 AS idx,
  coalesce(exp(sum(ln(r)) OVER (PARTITION BY event_type ORDER BY v DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1.0) AS f FROM e)"""


@query("km_table", f"WITH {KM_SQL} SELECT event_type, idx AS index, v, total, exact, round(f, 6) AS f FROM f")
def q_km_table(spark, sf):
    tab, _ = ST.kaplan_meier(_censored(spark, sf), ["event_type"], "v", "m")
    return tab.select("event_type", "index", "v", "total", "exact", r6(F.col("f")).alias("f"))


@query("km_summary", f"""WITH {KM_SQL}, s AS (SELECT *, CASE WHEN idx = max(idx) OVER (PARTITION BY event_type) THEN f ELSE f * (1 - r) END AS step FROM f)
SELECT event_type, round(sum(v * step), 6) AS mean, round((sum(v * v * step) - sum(v * step) * sum(v * step)) * any_value(n) / (any_value(n) - 1), 4) AS variance FROM s GROUP BY 1""")
def q_km_summary(spark, sf):
    _, summ = ST.kaplan_meier(_censored(spark, sf), ["event_type"], "v", "m")
    return summ.select("event_type", r6(F.col("mean")).alias("mean"), F.round("variance", 4).alias("variance"))


TAU_SQL = """WITH c AS (SELECT event_id, event_type, CASE WHEN value < 2 THEN 2.0 ELSE round(value, 0) END AS x, value >= 2 AS ex,
  CAST(CASE WHEN k < 5 THEN 5 ELSE k END AS DOUBLE) AS y, k >= 5 AS ey FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)),
p AS (SELECT a.event_type,
  CASE WHEN a.ex AND (b.x < a.x OR (b.x = a.x AND NOT b.ex)) THEN 1 WHEN b.ex AND (a.x < b.x OR (a.x = b.x AND NOT a.ex)) THEN -1 ELSE 0 END AS dx,
  CASE WHEN a.ey AND (b.y < a.y OR (b.y = a.y AND NOT b.ey)) THEN 1 WHEN b.ey AND (a.y < b.y OR (a.y = b.y AND NOT a.ey)) THEN -1 ELSE 0 END AS dy
  FROM c a JOIN c b ON a.event_type = b.event_type AND a.event_id < b.event_id)
SELECT p.event_type, any_value(n.n) AS n, CAST(count(*) FILTER (WHERE dx * dy = 1) AS BIGINT) AS concordant, CAST(count(*) FILTER (WHERE dx * dy = -1) AS BIGINT) AS discordant,
  round(sum(dx * dy) / sqrt(CAST(count(*) FILTER (WHERE dx <> 0) AS DOUBLE) * count(*) FILTER (WHERE dy <> 0)), 6) AS tau_b
FROM p JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) n ON p.event_type = n.event_type GROUP BY p.event_type"""


@query("kendall_tau_b", TAU_SQL)
def q_kendall(spark, sf):
    """Censored tau-b between the (censored) measurement value and the (censored) props term, per event type."""
    from assayflow.operators.kendall import kendall_tau_b

    e = Tables(spark, sf).events.select("event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    c = e.select("event_type", F.when(F.col("value") < 2, F.lit(2.0)).otherwise(F.round("value", 0)).alias("x"),
                 F.when(F.col("value") < 2, "<").otherwise("=").alias("mx"),
                 F.when(F.col("k") < 5, F.lit(5.0)).otherwise(F.col("k").cast("double")).alias("y"),
                 F.when(F.col("k") < 5, "<").otherwise("=").alias("my"))
    t = kendall_tau_b(c, ["event_type"], "x", "mx", "y", "my")
    return t.select("event_type", "n", "concordant", "discordant", r6(F.col("tau_b")).alias("tau_b"))
