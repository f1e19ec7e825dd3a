"""Kendall's tau-b with censored values, exact and without forming pairs.

Comparison rule (per variable, one-sided censoring per group): observation
i is definitely greater than j when i is exact and j's value is lower, or
equal with j censored below ('<').  Right-censored groups ('>') are handled
by negating the values (which flips the sign of that variable's
comparisons).  Pairs that cannot be ordered count as ties; mixing '<' and
'>' in one variable of a group is an error.  (The workbench routes '>'
through its '<' branch and orders exact-vs-censored ties by input position;
this implementation uses the symmetric rule above -- identical on the
worked example, tau-b = -0.338.)

With key K = (value, exact) ordered lexicographically (censored before
exact), "i > j" is ``exact_i and K_j < K_i``.  Hence

  C = #{(i, j): i >x j and i >y j}    (lower-left dominance, queries exact in x and y)
  D = #{(i, j): i >x j and j >y i}    (dominance on (reversed x rank, y rank))
  comparable pairs in x = sum over exact i of rank_x(i)

and tau-b = (C - D) / sqrt(nx * ny).

Dominance is counted by the digits of the first rank.  Two different ranks
agree in their upper digits down to one level, where the smaller has the
smaller digit; so each pair is met at one level, among the rows that share the
digits above it.  There the rows are ordered by the second rank, and running
sums of how many rows have a digit below 1, 2, ... give every row the number
of partners that come before it.  Rows with equal ranks travel as one counted
row, a tied value is spread over the ranks of the other variable, and no group,
tie or level is gathered in a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayflow.operators.metrics import checked
from assayflow.operators.ordered import attach, keyed_join, running_sums, with_row
from assayflow.session import materialize

DIGIT_BITS = 4


def _ranks(cells: DataFrame, by: Sequence[str], v: str, e: str, name: str) -> DataFrame:
    """rank = number of observations of the group with a strictly smaller (value, exact) key; and the
    reversed rank = number with a strictly larger key.  ``cells`` are counted rows (``__c``)."""
    k = materialize(cells.groupBy(*by, v, e).agg(F.sum("__c").alias("__k")))
    cum = running_sums(k, by, [v, e], ["__k"], ["__cum"])
    tot = k.groupBy(*by).agg(F.sum("__k").alias("__n"))
    cum = keyed_join(cum, tot, by) if by else with_row(cum, tot)
    r = cum.select(*by, v, e, (F.col("__cum") - F.col("__k")).alias(name), (F.col("__n") - F.col("__cum")).alias(f"{name}_rev"))
    return attach(cells, r, [*by, v, e])


def dominance_pairs(cells: DataFrame, by: Sequence[str], a: str, b: str, is_p: str, is_q: str, digit_bits: int = DIGIT_BITS) -> DataFrame:
    """Per group: number of (p, q) with a_p < a_q and b_p < b_q among counted rows (``__c``), where a and b are ranks in [0, n)."""
    by = list(by)
    size = 1 << digit_bits
    pts = cells.groupBy(*by, F.col(a).alias("__a"), F.col(b).alias("__b")).agg(
        F.sum(F.when(F.col(is_p).cast("boolean"), F.col("__c")).otherwise(0)).alias("__p"), F.sum(F.when(F.col(is_q).cast("boolean"), F.col("__c")).otherwise(0)).alias("__q"))
    highest = pts.agg(F.max("__a")).first()[0] or 0
    levels = max(1, -(-int(highest).bit_length() // digit_bits))
    # a row per level: the digits above it, and its own digit there
    each = pts.select("*", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("__level"))
    digit = F.expr(f"shiftright(__a, __level * {digit_bits})").bitwiseAND(size - 1)
    each = each.select(*by, "__level", F.expr(f"shiftright(__a, __level * {digit_bits} + {digit_bits})").alias("__up"), digit.alias("__digit"), "__b", "__p", "__q")
    keys = [*by, "__level", "__up"]
    rows = each.groupBy(*keys, "__b").agg(
        *[F.sum(F.when(F.col("__digit") < d, F.col("__p")).otherwise(0)).alias(f"__s{d}") for d in range(1, size)],
        *[F.sum(F.when(F.col("__digit") == d, F.col("__q")).otherwise(0)).alias(f"__q{d}") for d in range(1, size)],
    )
    cum = running_sums(materialize(rows), keys, ["__b"], [f"__s{d}" for d in range(1, size)], [f"__u{d}" for d in range(1, size)])
    pairs = sum((F.col(f"__q{d}") * (F.col(f"__u{d}") - F.col(f"__s{d}")) for d in range(1, size)), F.lit(0))
    return cum.groupBy(*by).agg(F.sum(pairs).alias("pairs"))


def kendall_tau_b(df: DataFrame, by: Sequence[str], x: str, mx: str, y: str, my: str, digit_bits: int = DIGIT_BITS) -> DataFrame:
    """Censored Kendall tau-b per group (see module doc): by..., n, concordant, discordant, tau_b."""
    by = list(by)
    dirs = df.groupBy(*by).agg(
        *[F.count_if(F.col(m).isin("<", "<=")).alias(f"__l{i}") for i, m in enumerate((mx, my))],
        *[F.count_if(F.col(m).isin(">", ">=")).alias(f"__r{i}") for i, m in enumerate((mx, my))],
    )
    flip = [F.when(F.col(f"__r{i}") > 0, F.lit(-1.0)).otherwise(F.lit(1.0)) for i in range(2)]
    ok = (F.col("__l0") == 0) | (F.col("__r0") == 0)
    ok = ok & ((F.col("__l1") == 0) | (F.col("__r1") == 0))
    dirs = dirs.select(*by, checked(flip[0], ok, "left and right censored values in one variable").alias("__fx"), flip[1].alias("__fy"))
    d = attach(df.select(*by, x, mx, y, my), dirs, by)
    keys = {"__x": F.col(x) * F.col("__fx"), "__ex": (F.col(mx) == "=").cast("int"), "__y": F.col(y) * F.col("__fy"), "__ey": (F.col(my) == "=").cast("int")}
    cells = d.groupBy(*by, *[c.alias(k) for k, c in keys.items()]).agg(F.count(F.lit(1)).alias("__c"), F.first(F.col("__fx") * F.col("__fy")).alias("__sign"))
    cells = _ranks(_ranks(materialize(cells), by, "__x", "__ex", "__rx"), by, "__y", "__ey", "__ry")
    cells = materialize(cells.withColumn("__all", F.lit(1)).withColumn("__both", F.col("__ex") * F.col("__ey")))
    conc = dominance_pairs(cells, by, "__rx", "__ry", "__all", "__both", digit_bits).withColumnRenamed("pairs", "concordant")
    disc = dominance_pairs(cells, by, "__rx_rev", "__ry", "__ex", "__ey", digit_bits).withColumnRenamed("pairs", "discordant")
    comp = cells.groupBy(*by).agg(
        F.sum("__c").alias("n"),
        F.sum(F.col("__ex") * F.col("__rx") * F.col("__c")).alias("__nx"),
        F.sum(F.col("__ey") * F.col("__ry") * F.col("__c")).alias("__ny"),
        F.first("__sign").alias("__sign"),
    )
    j = keyed_join(keyed_join(comp, conc, by), disc, by) if by else with_row(with_row(comp, conc), disc)
    tau = F.col("__sign") * (F.col("concordant") - F.col("discordant")) / F.sqrt(F.col("__nx").cast("double") * F.col("__ny").cast("double"))
    return j.select(*by, "n", "concordant", "discordant", F.when((F.col("__nx") > 0) & (F.col("__ny") > 0), tau).alias("tau_b"))
