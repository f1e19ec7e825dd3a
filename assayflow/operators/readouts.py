"""§2.15 readout-table builder: measurements -> one modelling table per (group, readout).

Measurements are one long DataFrame ``(molecule, row, readout, value_num,
value_str, modifier, ...)``; every "table" of the original workbench is a
``table_key`` group inside it, so all tables are built in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayflow.functions import scalar as S
from assayflow.operators import labels as L
from assayflow.operators.metrics import checked
from assayflow.operators.ordered import attach, keyed_join


def classification_table(df: DataFrame, by: Sequence[str], value: str, percent: float, direction: str | None = None,
                         out: str = "active") -> DataFrame:
    """0/1 table at a fixed percent active: threshold and direction from ``percent_active``."""
    th = L.percent_active(df, by, value, percent, direction).select(*by, "direction", "threshold")
    j = keyed_join(df, th, by)
    hit = F.when(F.col("direction") == "UP", F.col(value) >= F.col("threshold")).otherwise(F.col(value) <= F.col("threshold"))
    return j.withColumn(out, F.when(F.col(value).isNull(), F.lit(None).cast("double")).when(hit, 1.0).otherwise(0.0))


# ------------------------------------------------------------ decoding

READOUT_OBJECT = "struct<value:string,modifier:string,note:string,outlier_type:string>"
# Keys allowed inside a readout object
READOUT_KEYS = ("value", "modifier", "note", "outlier_type")


def decode_readouts(rows: DataFrame, readouts_col: str = "readouts") -> DataFrame:
    """Measurement rows with ``readouts`` = JSON object {definition id: scalar | {value, modifier, note, outlier_type}}
    -> long form (..., definition, value_str, value_num, modifier).  Unknown object keys fail the job;
    the default modifier is '='; readouts whose value is null are dropped."""
    m = F.from_json(F.col(readouts_col), "map<string,string>")
    keep = [c for c in rows.columns if c != readouts_col]
    e = rows.select(*keep, F.explode(m).alias("definition", "__raw"))
    is_obj = F.trim(F.col("__raw")).startswith("{")
    obj = F.from_json(F.col("__raw"), READOUT_OBJECT)
    keys = F.map_keys(F.from_json(F.col("__raw"), "map<string,string>"))
    unknown = F.size(F.array_except(keys, F.array(*[F.lit(k) for k in READOUT_KEYS])))
    value = F.when(is_obj, checked(obj["value"], unknown == 0, "Unknown readout key")).otherwise(F.col("__raw"))
    mod = F.when(is_obj, F.coalesce(obj["modifier"], F.lit("="))).otherwise(F.lit("="))
    out = e.select(*keep, "definition", value.alias("value_str"), S.modifier(mod).alias("modifier"))
    return out.filter(F.col("value_str").isNotNull()).withColumn("value_num", S.numeric_text(F.col("value_str")))


# ------------------------------------------------------- per-row shapes

def wide_readouts(long: DataFrame, keys: Sequence[str], readout: str, value: str, names: Sequence[str]) -> DataFrame:
    """Measurement rows x readout definitions (missing -> null)."""
    return long.groupBy(*keys).pivot(readout, list(names)).agg(F.first(value, ignorenulls=True))


def meta_pairs(long: DataFrame, row_keys: Sequence[str], readout: str, label: str) -> DataFrame:
    """Each measurement row -> (label value, modifier, map of the other readouts by name) -- bounded by readouts per row."""
    g = long.groupBy(*row_keys).agg(
        F.max(F.when(F.col(readout) == label, F.col("value_num"))).alias("value"),
        F.max(F.when(F.col(readout) == label, F.col("modifier"))).alias("modifier"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(readout) != label, F.struct(F.col(readout), F.col("value_str")))))).alias("terms"),
    )
    return g


def distinct_readout_values(long: DataFrame, readout: str, name: str) -> DataFrame:
    return long.filter(F.col(readout) == name).select("value_str").distinct()


# --------------------------------------------------- replicate collapse

def collapse_censored(df: DataFrame, keys: Sequence[str], value: str = "value", modifier: str = "modifier", mixed: str = "error") -> DataFrame:
    """One value per key: mean of exact readings (+ mean log10 when all > 0); else max of '>' readings;
    else min of '<' readings.  '<' and '>' without an exact reading is an error, or with ``mixed="greater"``
    the max of the '>' readings: in large tables such a key turns up by chance and must not end the job."""
    if mixed not in ("error", "greater"):
        raise ValueError(f"Unknown rule for mixed readings {mixed}")
    v, m = F.col(value), F.col(modifier)
    eq, gt, lt = m == "=", S.is_greater(m), S.is_less(m)
    g = df.groupBy(*keys).agg(
        F.count_if(eq).alias("__ne"), F.count_if(gt).alias("__ng"), F.count_if(lt).alias("__nl"),
        F.avg(F.when(eq, v)).alias("__mean"), F.count_if(eq & (v <= 0)).alias("__nonpos"),
        F.avg(F.when(eq & (v > 0), F.log10(v))).alias("__lmean"),
        F.max(F.when(gt, v)).alias("__max"), F.min(F.when(lt, v)).alias("__min"),
    )
    outv = F.when(F.col("__ne") > 0, F.col("__mean")).when(F.col("__ng") > 0, F.col("__max")).otherwise(F.col("__min"))
    outm = F.when(F.col("__ne") > 0, F.lit("=")).when(F.col("__ng") > 0, F.lit(">")).otherwise(F.lit("<"))
    logv = (
        F.when(F.col("__ne") > 0, F.when(F.col("__nonpos") == 0, F.col("__lmean")))
        .when(F.col("__ng") > 0, F.when(F.col("__max") > 0, F.log10("__max")))
        .otherwise(F.when(F.col("__min") > 0, F.log10("__min")))
    )
    if mixed == "error":
        both = (F.col("__ne") == 0) & (F.col("__ng") > 0) & (F.col("__nl") > 0)
        outm = checked(outm, ~both, "'<' and '>' readings without an exact value")
    return g.select(*keys, outm.alias("modifier"),
                    outv.alias("value"), logv.alias("log_value"), (F.col("__ne") + F.col("__ng") + F.col("__nl")).alias("n_readings"))


def common_terms(terms_long: DataFrame, group: Sequence[str], member: Sequence[str], key: str = "key", value: str = "value") -> DataFrame:
    """Term (key, value) pairs shared by every member of the group (long form)."""
    from assayflow.operators.table import map_intersect

    return map_intersect(terms_long, group, member, key, value)


# ------------------------------------------------------------ tables

def _proven_copies(members: DataFrame, sig: DataFrame, protocol: str, row_id: str) -> DataFrame:
    """Splits (``table_key``) whose members are those of an earlier split of their signature class.

    A class is compared member by member with its first split: a split of as many members, all of which agree, is a copy.
    The others (different sets of one signature) are compared among themselves in the next round, if there are any.
    """
    from assayflow.session import materialize

    copies = None
    while True:
        first = sig.groupBy(protocol, "__n", "__h1", "__h2").agg(F.min("table_key").alias("__first"), F.count(F.lit(1)).alias("__k")).filter("__k > 1")
        pairs = materialize(keyed_join(sig, first.drop("__k"), [protocol, "__n", "__h1", "__h2"]).filter("table_key <> __first"))
        if pairs.isEmpty():
            break
        later = keyed_join(members, pairs.select("table_key", "__first"), ["table_key"])
        of_first = members.select(F.col("table_key").alias("__first"), row_id, F.lit(1).alias("__agrees"))
        same = keyed_join(later, of_first, ["__first", row_id], "left").groupBy("table_key").agg(F.count("__agrees").alias("__same"))
        proven = materialize(keyed_join(pairs, same, ["table_key"]).filter(F.col("__same") == F.col("__n")).select("table_key"))
        copies = proven if copies is None else copies.unionByName(proven)
        sig = materialize(pairs.join(proven, "table_key", "left_anti").drop("__first"))
    return sig.select("table_key").limit(0) if copies is None else copies


def group_tables(rows: DataFrame, protocol: str, split_cols: Sequence[str], label_readout: str, row_id: str) -> DataFrame:
    """Table key per measurement row: md5(protocol : label readout : split values); only observed
    combinations exist.  Splits whose member rows equal those of an earlier split (by key) are dropped.

    Equal splits have equal signatures (number of members and two order-free hashes); what shares one is compared
    member by member before it is dropped, so different splits never go.
    """
    from assayflow.session import materialize

    key = S.table_md5(F.col(protocol), F.lit(label_readout), *[F.coalesce(F.col(c), F.lit("NA")) for c in split_cols])
    t = rows.withColumn("table_key", key)
    members = t.select(protocol, "table_key", row_id).distinct()
    sig = materialize(members.groupBy(protocol, "table_key").agg(
        F.count(F.lit(1)).alias("__n"), F.sum(F.xxhash64(row_id).cast("decimal(38,0)")).alias("__h1"), F.sum(F.hash(row_id).cast("long")).alias("__h2")))
    copies = _proven_copies(members.drop(protocol), sig, protocol, row_id)
    kept = sig.select("table_key").join(copies, "table_key", "left_anti")
    return attach(t, kept, ["table_key"])


def data_tables(rows: DataFrame, table_key: str, molecule: str, features: DataFrame, terms: DataFrame | None = None,
                min_rows: int = 100, mixed: str = "error") -> DataFrame:
    """One row per (table, molecule): replicates collapsed (``mixed`` as there), features attached (molecules without complete
    features drop out), ``label`` and ``log_label``; tables with at most ``min_rows`` rows dropped; key uniqueness checked."""
    c = collapse_censored(rows, [table_key, molecule], mixed=mixed)
    j = c.join(features, molecule, "inner")
    n = j.groupBy(table_key).agg(F.count(F.lit(1)).alias("__rows"), F.countDistinct(molecule).alias("__mols"))
    j = j.join(n.filter(F.col("__rows") > min_rows), table_key)
    out = j.withColumn(molecule, checked(F.col(molecule), F.col("__rows") == F.col("__mols"), "duplicate molecule in a table"))
    return out.drop("__rows", "__mols").withColumnRenamed("value", "label").withColumnRenamed("log_value", "log_label")


def complete_features(molecules: DataFrame, key: str, feature_frames: Sequence[DataFrame], names: Sequence[str]) -> DataFrame:
    """Attach feature columns by key; a molecule missing any of them gets a null ``features`` struct."""
    out = molecules
    for f in feature_frames:
        out = out.join(f, key, "left")
    allv = F.lit(True)
    for n in names:
        allv = allv & F.col(n).isNotNull()
    return out.select(key, F.when(allv, F.struct(*names)).alias("features"))


def ic50_unit(definition_unit: Column, term_units: Column) -> Column:
    """Unit from the readout definition when it names a concentration; '%' and 'ug/mL' mean none;
    any other definition unit fails; without one, the first term value (terms whose name contains
    'unit', sorted by name) that names a concentration."""
    from_def = S.unit_name(definition_unit)
    terms = F.filter(term_units, lambda u: S.unit_name(u).isNotNull())
    from_terms = S.unit_name(F.get(terms, 0))
    return (
        F.when(definition_unit.isNull(), from_terms)
        .when(from_def.isNotNull(), from_def)
        .when(definition_unit.isin("%", "ug/mL"), F.lit(None).cast("string"))
        .otherwise(F.raise_error(F.concat(F.lit("Unknown unit "), definition_unit)).cast("string"))
    )


def regression_label(label: Column, unit: Column) -> Column:
    """pIC50 label when the concentration unit is known, else the raw label."""
    return F.when(unit.isNotNull() & (label > 0), L.pic50(label, S.unit_exponent(unit))).otherwise(label)


def iterate_tables(tables: DataFrame, table_key: str, label: str, min_rows: int = 100, min_distinct: int = 90) -> DataFrame:
    """Tables with at least ``min_rows`` rows and more than ``min_distinct`` distinct labels.

    Labels are averages of replicates, whose last bits depend on summation
    order (partitioning); they are compared at 1e-9 so that the selection
    does not change between runs.
    """
    ok = tables.groupBy(table_key).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.round(label, 9)).alias("nd")).filter(
        (F.col("n") >= min_rows) & (F.col("nd") > min_distinct))
    return tables.join(ok.select(table_key), table_key, "left_semi")


def readout_counts(long: DataFrame, keys: Sequence[str], readout: str) -> DataFrame:
    """Values per (dataset, protocol, readout) and the 'use readout' keyword flag for numeric readouts."""
    g = long.groupBy(*keys, readout).agg(F.count(F.lit(1)).alias("count"), F.count("value_num").alias("n_numeric"))
    return g.withColumn("use_readout", (F.col("n_numeric") > 0) & S.keyword_flag(F.lower(F.col(readout))))


def validation_log(lines: DataFrame, line_no: str, text: str, name_re: str, cat_re: str) -> DataFrame:
    """(name, category, result file) from a run log: each category line is paired with the closest preceding
    name line.  Forward fill by segment number (running count of name lines) -- no whole-file window."""
    from assayflow.operators.ordered import running_sums

    t = lines.select(line_no, F.regexp_extract(text, name_re, 1).alias("__name"), F.regexp_extract(text, cat_re, 1).alias("category"),
                     F.regexp_extract(text, cat_re, 2).alias("result_file"))
    t = t.withColumn("__isname", (F.col("__name") != "").cast("long"))
    seg = running_sums(t, [], [line_no], ["__isname"], ["__seg"])
    names = seg.filter(F.col("__isname") == 1).select("__seg", F.col("__name").alias("name"))
    cats = seg.filter(F.col("category") != "")
    return cats.join(names, "__seg").select("name", "category", "result_file", line_no)
