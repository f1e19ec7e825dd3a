"""DuckDB CTEs for the derived modelling tables (mirror ``inputs.Tables``)."""

SCORED = """
scored AS (
  SELECT l.doc_id, d.lang, CAST(l.quality AS DOUBLE) AS label, CAST(l.toxic AS DOUBLE) AS toxic,
         CASE WHEN m.mx = m.mn THEN CAST(0 AS DOUBLE) ELSE (d.n_chars - m.mn) / (m.mx - m.mn) END AS probability
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id
  JOIN (SELECT d2.lang, min(d2.n_chars) AS mn, max(d2.n_chars) AS mx
        FROM labels l2 JOIN documents d2 ON l2.doc_id = d2.doc_id GROUP BY d2.lang) m ON d.lang = m.lang
)"""

REGRESSION = """
reg AS (
  SELECT li.l_orderkey, li.l_linenumber, li.l_partkey, li.l_suppkey, li.l_shipdate, li.l_returnflag, li.l_linestatus,
         li.l_extendedprice AS label, li.l_quantity * p.p_retailprice AS prediction, li.l_discount
  FROM lineitem li JOIN part p ON li.l_partkey = p.p_partkey
)"""


def prec(tp="tp", fp="fp"):
    return f"(CASE WHEN {tp} + {fp} = 0 THEN CAST(0 AS DOUBLE) ELSE {tp} / ({tp} + {fp}) END)"


def rec(tp="tp", fn="fn"):
    return f"(CASE WHEN {tp} + {fn} = 0 THEN CAST(0 AS DOUBLE) ELSE {tp} / ({tp} + {fn}) END)"


def spec(tn="tn", fp="fp"):
    return f"(CASE WHEN {tn} + {fp} = 0 THEN CAST(0 AS DOUBLE) ELSE {tn} / ({tn} + {fp}) END)"


def f1(p=None, r=None):
    p = p or prec()
    r = rec() if r is None else r
    return f"(CASE WHEN {r} = 0 OR {p} = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(2 AS DOUBLE) * {p} * {r} / ({p} + {r}) END)"


def ba():
    return f"(({spec()} + {rec()}) / 2)"


MEAS = """
meas AS (
  SELECT event_id AS row, user_id AS molecule, event_type AS protocol, value AS activity,
         CASE WHEN value >= 300 THEN '>' WHEN value < 1 THEN '<' ELSE '=' END AS modifier,
         CASE WHEN k < 50 THEN 'kinase' ELSE 'protease' END AS target,
         CASE WHEN k < 25 THEN 'uM' WHEN k < 50 THEN 'nM' WHEN k < 75 THEN 'pM' ELSE 'mM' END AS units
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
)"""
