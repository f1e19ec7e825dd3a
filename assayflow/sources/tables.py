"""§2.1 sources and §2.2 sinks.

Headers and recipes are metadata (read on the driver); all row data goes
through Spark readers and Column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayflow.functions import scalar as S
from assayflow.operators.metrics import checked
from assayflow.operators.ordered import at_most, attach

# The five column types of a typed header
TYPES = ("String", "Int", "Double", "SparseVector", "DenseVector")
_HEADER = re.compile(r"^(.*\S)\s*\[(\w+)\]$")


def parse_header(name: str) -> tuple[str, str | None]:
    m = _HEADER.match(name)
    if not m:
        return name, None
    title, typ = m.group(1), m.group(2)
    if typ not in TYPES:
        raise ValueError(f"Unknown column type {typ} in header {name}")
    return title, typ


def _typed(c: Column, typ: str) -> Column:
    if typ == "String":
        return c
    if typ == "Int":
        return c.cast("int")
    if typ == "Double":
        return c.cast("double")
    if typ == "DenseVector":
        return F.when(c.isNull(), F.lit(None)).otherwise(S.text_to_dense(c))
    if typ == "SparseVector":
        return F.when(c.isNull(), F.lit(None)).otherwise(S.text_to_sparse(c))
    raise ValueError(typ)


def read_typed_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """CSV (or .csv.gz) with ``title [Type]`` headers; empty field -> null; vector text decoded; a quoted text may hold
    line breaks, separators and doubled quotes.  Without a type on every header the columns are inferred (``infer_types``)."""
    raw = spark.read.options(header=True, sep=sep, inferSchema=False, multiLine=True, quote='"', escape='"').csv(path)
    parsed = [parse_header(c) for c in raw.columns]
    if any(t is None for _, t in parsed):
        return infer_types(raw.select(*[F.col(f"`{c}`").alias(t) for c, (t, _) in zip(raw.columns, parsed)]))
    return raw.select(*[_typed(F.col(f"`{c}`"), typ).alias(t) for c, (t, typ) in zip(raw.columns, parsed)])


def inferred_types(df: DataFrame) -> DataFrame:
    """Per column: Int if every non-null value parses as an int, else Double if as a double, else String.
    A column holding only nulls is an error.  One aggregation pass for all columns."""
    aggs = []
    for c in df.columns:
        v = F.col(f"`{c}`").cast("string")
        aggs += [
            F.count(v).alias(f"{c}__n"),
            F.count_if(v.isNotNull() & v.try_cast("int").isNull()).alias(f"{c}__noint"),
            F.count_if(v.isNotNull() & v.try_cast("double").isNull()).alias(f"{c}__nodbl"),
        ]
    g = df.agg(*aggs)
    rows = []
    for c in df.columns:
        typ = (
            F.when(F.col(f"`{c}__noint`") == 0, F.lit("Int")).when(F.col(f"`{c}__nodbl`") == 0, F.lit("Double")).otherwise(F.lit("String"))
        )
        rows.append(F.struct(F.lit(c).alias("column"), checked(typ, F.col(f"`{c}__n`") > 0, f"column {c} has no values").alias("type")))
    return g.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def infer_types(df: DataFrame) -> DataFrame:
    """Cast every column to its inferred type (the type list is a width-sized metadata result)."""
    types = {r["column"]: r["type"] for r in inferred_types(df).collect()}
    return df.select(*[_typed(F.col(f"`{c}`"), types[c]).alias(c) for c in df.columns])


def read_csv_dir(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A partitioned CSV directory with a header line per part file."""
    r = spark.read.option("header", True)
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)


def vector_text(c: Column, dtype: T.DataType) -> tuple[Column, str]:
    if isinstance(dtype, T.ArrayType):
        return S.dense_to_text(c), "DenseVector"
    if isinstance(dtype, T.StructType) and {f.name for f in dtype.fields} == {"length", "indices", "values"}:
        return S.sparse_to_text(c["length"], c["indices"], c["values"]), "SparseVector"
    if isinstance(dtype, (T.IntegerType, T.LongType, T.ShortType)):
        return c.cast("string"), "Int"
    if isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
        return c.cast("string"), "Double"
    return c.cast("string"), "String"


def write_typed_csv(df: DataFrame, path: str, write_types: bool = True, gzip: bool = False, mode: str = "overwrite", sep: str = ",") -> None:
    """CSV with optional ``title [Type]`` headers; vectors in text form; gzip output cannot be appended."""
    if gzip and mode == "append":
        raise ValueError("gzip output cannot be appended")
    cols = []
    for f in df.schema.fields:
        c, typ = vector_text(F.col(f"`{f.name}`"), f.dataType)
        cols.append(c.alias(f"{f.name} [{typ}]" if write_types else f.name))
    w = df.select(*cols).write.mode(mode).options(header=True, sep=sep, quote='"', escape='"')
    if gzip:
        w = w.option("compression", "gzip")
    w.csv(path)


def strip_types(df: DataFrame) -> DataFrame:
    """Remove ' [Type]' from column titles."""
    return df.select(*[F.col(f"`{c}`").alias(S.strip_type(c)) for c in df.columns])


# ------------------------------------------------------------ record files

RECORD_END = "$$$$"


def write_records(df: DataFrame, path: str, title: str, fields: Sequence[str]) -> None:
    """Multi-line record file: title block, then ``> <field>`` / value / blank line per field, then ``$$$$``."""
    parts = [F.coalesce(F.col(title).cast("string"), F.lit(""))]
    for f in fields:
        parts += [F.lit(f"\n> <{f}>\n"), F.coalesce(F.col(f).cast("string"), F.lit("")), F.lit("\n")]
    parts.append(F.lit("\n" + RECORD_END))
    df.select(F.concat(*parts).alias("value")).write.mode("overwrite").text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: ``title`` (first line; the structure block is kept as text, not parsed),
    ``block`` and a ``fields`` map built from the ``> <name>`` data blocks."""
    raw = spark.read.option("lineSep", RECORD_END + "\n").text(path)
    v = F.regexp_replace(F.col("value"), "\r\n", "\n")
    # a data block runs to the next blank line or field, over as many lines as it has
    data = F.lit(r"(?ms)^> *<([^>]+)>[^\n]*\n(.*?)(?=\n\s*\n|\n> *<|\s*\z)")
    names, vals = F.regexp_extract_all(v, data, 1), F.regexp_extract_all(v, data, 2)
    return raw.filter(F.trim("value") != "").select(
        F.substring_index(v, "\n", 1).alias("title"),
        v.alias("block"),
        F.map_from_arrays(names, F.transform(vals, lambda x: F.when(x == "", F.lit(None)).otherwise(x))).alias("fields"),
    )


def record_fields(records: DataFrame, min_numeric: float = 0.10) -> DataFrame:
    """All field names with present / numeric counts; ``numeric`` when at least 10 % of present values parse."""
    e = records.select(F.explode("fields").alias("field", "value"))
    g = e.groupBy("field").agg(F.count("value").alias("present"), F.count(S.numeric_text(F.col("value"))).alias("n_numeric"))
    return g.withColumn("numeric", F.col("n_numeric") >= F.lit(min_numeric) * F.col("present"))


def field_column(records: DataFrame, field: str, numeric: bool = False, min_numeric: float = 0.10) -> Column:
    """Typed column for one field; a numeric request on a field under 10 % numeric fails the job."""
    v = F.col("fields")[field]
    if not numeric:
        return v
    st = records.agg(F.count(v).alias("p"), F.count(S.numeric_text(v)).alias("n")).select(F.col("n") >= F.lit(min_numeric) * F.col("p")).scalar()
    return checked(S.numeric_text(v), st, f"field {field} is not numeric")


def read_smiles_lines(spark: SparkSession, path: str) -> DataFrame:
    """``structure id`` line file; a line without exactly two terms fails the job."""
    t = spark.read.text(path).filter(F.trim("value") != "")
    parts = F.split(F.trim(F.col("value")), r"\s+")
    return t.select(checked(parts[0], F.size(parts) == 2, "line must hold exactly two terms").alias("smiles"), parts[1].alias("id"))


def read_recipe(spark: SparkSession, path: str) -> DataFrame:
    """JSON array of {file, response, category, transform}."""
    return spark.read.option("multiLine", True).schema("file string, response string, category string, transform string").json(path)


def apply_recipe(records: DataFrame, key: str, recipe: DataFrame, file: str | None = None) -> DataFrame:
    """Long table (key, response, category, raw text, value) for every recipe field of every record.

    A recipe row counts for the records of its file: ``records`` come from the file of that name, or carry a column
    ``file``; without either the recipe must be about one file.  The recipe is small (one row per field, size checked by
    ``attach``); the value rule (category, transform) is applied with Column expressions for each distinct rule.
    """
    if file is None and "file" not in records.columns:
        files = [r["file"] for r in recipe.select("file").distinct().limit(2).collect()]
        if len(files) > 1:
            raise ValueError("the recipe is about several files: name the one the records come from")
        file = files[0] if files else ""
    source = F.col("file") if "file" in records.columns else F.lit(file)
    rules = [tuple(r) for r in recipe.select("category", "transform").distinct().collect()]  # a handful of rules
    r = recipe.select("file", "response", "category", "transform")
    e = attach(records.select(key, source.alias("file"), F.explode("fields").alias("response", "raw")), r, ["file", "response"])
    val = F.lit(None).cast("double")
    for cat, tr in rules:
        cond = (F.col("category") == cat) & (F.col("transform").eqNullSafe(F.lit(tr)))
        val = F.when(cond, S.field_value(F.coalesce(F.col("raw"), F.lit("")), cat, tr)).otherwise(val)
    return e.select(key, "response", "category", "raw", val.alias("value"))


# --------------------------------------------------------- system folders

def write_systems(df: DataFrame, root: str, system_col: str) -> None:
    df.write.mode("overwrite").partitionBy(system_col).parquet(root)


def scan_systems(spark: SparkSession, root: str, system_col: str, take: int | None = None,
                 include: Sequence[str] | None = None, exclude: Sequence[str] | None = None) -> DataFrame:
    """All systems under ``root`` sorted by on-disk size (smallest first); optional take-n / include / exclude.
    Returns the rows of the selected systems (the system list itself is metadata-sized)."""
    df = spark.read.parquet(root).select("*", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_size").alias("__s"))
    sizes = df.select(system_col, "__f", "__s").distinct().groupBy(system_col).agg(F.sum("__s").alias("bytes"))
    if include:
        sizes = sizes.filter(F.col(system_col).isin(list(include)))
    if exclude:
        sizes = sizes.filter(~F.col(system_col).isin(list(exclude)))
    if take is not None:
        sizes = sizes.orderBy("bytes", system_col).limit(take)
    return df.join(sizes.select(system_col), system_col, "left_semi").drop("__f", "__s")


def label_columns(df: DataFrame) -> DataFrame:
    return df.select(*[f"`{c}`" for c in df.columns if "activity" in c])


def vector_width(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    return df.groupBy(*by).agg(F.max(F.size(col)).alias("width"))


# ------------------------------------------------------------------ sinks

def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


#: Rows that one CSV file may hold.
SINGLE_CSV_ROWS = 1_000_000


def write_single_csv(df: DataFrame, path: str) -> None:
    """Result-sized tables only: one CSV part file; a larger table is refused."""
    if not at_most(df, SINGLE_CSV_ROWS):
        raise ValueError(f"more than {SINGLE_CSV_ROWS} rows for a single file")
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def append_once(spark: SparkSession, new: DataFrame, path: str, name_col: str = "NAME") -> None:
    """Append result rows unless rows for that name are already stored."""
    if _exists(spark, path):
        done = spark.read.parquet(path).select(name_col).distinct()
        new = new.join(done, name_col, "left_anti")
        new.write.mode("append").parquet(path)
    else:
        new.write.mode("overwrite").parquet(path)


def skip_done(spark: SparkSession, todo: DataFrame, path: str, name_col: str = "NAME") -> DataFrame:
    """Names already in the stored results are excluded from the run."""
    if not _exists(spark, path):
        return todo
    return todo.join(spark.read.parquet(path).select(name_col).distinct(), name_col, "left_anti")


def materialize_once(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """Compute once and store; later calls read the stored result."""
    if not _exists(spark, path):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
