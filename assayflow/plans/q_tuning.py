"""§2.14 tuning-result analysis queries over a results table computed from the driver data:
one row per (system = return flag, feature = line status, discount, tax) with the RMSE of the price model."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayflow.operators import tuning as TU
from assayflow.operators.metrics import regression_metrics
from assayflow.plans.inputs import Tables
from assayflow.plans.q_metrics import r6
from assayflow.plans.registry import query

RES_SQL = """res AS (SELECT l_returnflag AS name, l_linestatus AS feature, l_discount AS disc, round(l_tax, 2) AS tax,
  round(sqrt(avg((l_extendedprice - l_quantity * p_retailprice) * (l_extendedprice - l_quantity * p_retailprice))), 6) AS rmse
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


def _results(spark, sf):
    t = Tables(spark, sf)
    li = t.lineitem.select("l_partkey", "l_returnflag", "l_linestatus", "l_discount", F.round("l_tax", 2).alias("tax"), "l_quantity", "l_extendedprice")
    j = li.join(t.part.select("p_partkey", "p_retailprice"), li.l_partkey == F.col("p_partkey"))
    j = j.select(F.col("l_returnflag").alias("name"), F.col("l_linestatus").alias("feature"), F.col("l_discount").alias("disc"), "tax",
                 F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * F.col("p_retailprice")).alias("prediction"))
    m = regression_metrics(j, ["name", "feature", "disc", "tax"], "label", "prediction")
    return m.select("name", "feature", "disc", "tax", r6(F.col("rmse")).alias("rmse"))


@query("tune_global_best", f"WITH {RES_SQL} SELECT name, min(rmse) AS global FROM res GROUP BY name")
def q_global_best(spark, sf):
    return TU.global_best(_results(spark, sf), "name", "rmse", False)


COMMON_SQL = f"""{RES_SQL}, g AS (SELECT name, min(rmse) AS global FROM res GROUP BY name),
per AS (SELECT feature, disc, tax, sqrt(avg((rmse - global) * (rmse - global))) AS rms_to_best, avg(rmse) AS mean_metric FROM res JOIN g ON res.name = g.name GROUP BY ALL),
cb AS (SELECT * FROM per ORDER BY rms_to_best, feature, disc, tax LIMIT 1)"""


@query("tune_common_best", f"WITH {COMMON_SQL} SELECT feature, disc, tax, round(rms_to_best, 6) AS rms_to_best, round(mean_metric, 6) AS mean_metric FROM cb")
def q_common_best(spark, sf):
    c = TU.common_best(_results(spark, sf), "name", ["feature", "disc", "tax"], "rmse", False)
    return c.select("feature", "disc", "tax", r6(F.col("rms_to_best")).alias("rms_to_best"), r6(F.col("mean_metric")).alias("mean_metric"))


@query("tune_common_by_feature", f"""WITH {RES_SQL}, g AS (SELECT feature, name, min(rmse) AS global FROM res GROUP BY ALL),
per AS (SELECT res.feature, disc, tax, sqrt(avg((rmse - global) * (rmse - global))) AS rms_to_best, avg(rmse) AS mean_metric FROM res JOIN g ON res.name = g.name AND res.feature = g.feature GROUP BY ALL)
SELECT feature, disc, tax, round(rms_to_best, 6) AS rms_to_best, round(mean_metric, 6) AS mean_metric FROM (
  SELECT *, row_number() OVER (PARTITION BY feature ORDER BY rms_to_best, disc, tax) AS rn FROM per) WHERE rn = 1""")
def q_common_by_feature(spark, sf):
    c = TU.common_best_by(_results(spark, sf), ["feature"], "name", ["disc", "tax"], "rmse", False)
    return c.select("feature", "disc", "tax", r6(F.col("rms_to_best")).alias("rms_to_best"), r6(F.col("mean_metric")).alias("mean_metric"))


DELTA_SQL = f"""{COMMON_SQL}, cm AS (SELECT res.name, res.rmse AS common FROM res JOIN cb ON res.feature = cb.feature AND res.disc = cb.disc AND res.tax = cb.tax),
d AS (SELECT g.name, g.global, cm.common, round(cm.common - g.global, 6) AS delta FROM g JOIN cm ON g.name = cm.name)"""


@query("tune_delta", f"WITH {DELTA_SQL} SELECT * FROM d")
def q_delta(spark, sf):
    d = TU.delta_table(_results(spark, sf), "name", ["feature", "disc", "tax"], "rmse", False)
    return d.withColumn("delta", r6(F.col("delta")))


@query("tune_category", f"WITH {DELTA_SQL} SELECT name, 'global' AS cat, global AS value FROM d UNION ALL SELECT name, 'common', common FROM d")
def q_category(spark, sf):
    d = TU.delta_table(_results(spark, sf), "name", ["feature", "disc", "tax"], "rmse", False)
    return TU.category_table(d, "name")


@query("tune_complete_methods", f"""WITH {RES_SQL}, cov AS (SELECT feature AS method, count(DISTINCT name) AS n_systems, round(avg(rmse), 6) AS mean_metric FROM res GROUP BY 1)
SELECT * FROM cov WHERE n_systems = (SELECT max(n_systems) FROM cov)""")
def q_complete_methods(spark, sf):
    r = _results(spark, sf).withColumnRenamed("feature", "method")
    c = TU.complete_methods(r, "method", "name", "rmse")
    return c.withColumn("mean_metric", r6(F.col("mean_metric")))


@query("tune_best_params_list", f"""WITH {RES_SQL} SELECT DISTINCT 'disc' AS parameter, CAST(disc AS VARCHAR) AS value FROM res
UNION ALL SELECT DISTINCT 'tax', CAST(tax AS VARCHAR) FROM res""")
def q_best_params_list(spark, sf):
    return TU.best_params_list(_results(spark, sf), ["disc", "tax"])


@query("tune_best_row_per_file", f"""WITH {RES_SQL} SELECT feature, name, disc, tax, rmse FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY rmse, name, disc, tax) AS rn FROM res) WHERE rn = 1""")
def q_best_row_per_file(spark, sf):
    r = _results(spark, sf)
    b = r.groupBy("feature").agg(F.min_by(F.struct("name", "disc", "tax", "rmse"), F.struct("rmse", "name", "disc", "tax")).alias("b"))
    return b.select("feature", "b.*")


@query("tune_generalization", f"""WITH {RES_SQL}, m AS (SELECT name, feature, disc AS method, avg(rmse) AS rmse FROM res GROUP BY ALL),
tr AS (SELECT * FROM m WHERE feature = 'F'), sc AS (SELECT * FROM m WHERE feature = 'O'),
bt AS (SELECT name, arg_min(method, (rmse, method)) AS train_method FROM tr GROUP BY 1),
bs AS (SELECT name, arg_min(method, (rmse, method)) AS score_method, min(rmse) AS best_score FROM sc GROUP BY 1)
SELECT bt.name, bt.train_method, round(sc.rmse, 6) AS train_method_score, bs.score_method, round(bs.best_score, 6) AS best_score, round(sc.rmse - bs.best_score, 6) AS delta
FROM bt JOIN sc ON bt.name = sc.name AND bt.train_method = sc.method JOIN bs ON bt.name = bs.name""")
def q_generalization(spark, sf):
    r = _results(spark, sf).groupBy("name", "feature", F.col("disc").alias("method")).agg(F.avg("rmse").alias("rmse"))
    g = TU.generalization(r.filter(F.col("feature") == "F"), r.filter(F.col("feature") == "O"), "name", "method", "rmse", False)
    return g.select("name", "train_method", r6(F.col("train_method_score")).alias("train_method_score"), "score_method",
                    r6(F.col("best_score")).alias("best_score"), r6(F.col("delta")).alias("delta"))
