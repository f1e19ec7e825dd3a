"""§2.12 feature transformers on ``array<double>`` (dense) and exploded ``(id, idx, val)`` (sparse).

Per-position statistics are width-sized (one entry per feature), never
row-sized: they are aggregated with partial/final aggregation and handed to
the row-wise expression as a scalar subquery (computed once, broadcast as a
value).  MLlib vectors appear only at the model boundary (``to_ml_vector``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayflow.operators.metrics import checked
from assayflow.operators.ordered import with_row
from assayflow.operators.summaries import summary_stats
from assayflow.session import scratch_dir


def dense(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("array<double>")


def to_ml_vector(col: str | Column) -> Column:
    from pyspark.ml.functions import array_to_vector

    return array_to_vector(dense(col))


# ---------------------------------------------------------------- statistics

def vector_stats(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """count, mean, min, max, population variance and sd per vector position (dense)."""
    long = df.select(*by, F.posexplode(dense(col)).alias("pos", "__v"))
    return summary_stats(long, [*by, "pos"], "__v")


def sparse_vector_stats(long: DataFrame, idx: str, val: str, n_rows: Column) -> DataFrame:
    """Per-index stats of exploded sparse vectors, implicit zeros counted (``n_rows`` vectors)."""
    return summary_stats(long, [idx], val, n_rows=n_rows)


def _stats_array(stats: DataFrame) -> Column:
    """Width-sized array of per-position stats, ordered by position, as a scalar subquery."""
    return stats.agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "min", "max", "sd"))).alias("a")).scalar()


# ------------------------------------------------------------------ scalers

def standard_scale(df: DataFrame, col: str, out: str, center: bool = False, scale: bool = True) -> DataFrame:
    """(x - mean) / sd per position; population sd; sd of 0 or NaN leaves the value undivided."""
    st = df.withColumn("__st", _stats_array(vector_stats(df, col)))

    def f(x, i):
        s = F.col("__st")[i]
        v = x - s["mean"] if center else x
        if scale:
            v = F.when(s["sd"].isNotNull() & ~F.isnan(s["sd"]) & (s["sd"] > 0), v / s["sd"]).otherwise(v)
        return v

    return st.withColumn(out, F.transform(dense(col), f)).drop("__st")


def minmax_scale(df: DataFrame, col: str, out: str, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Rescale each position to [lo, hi]; a constant position maps to ``lo``."""
    st = df.withColumn("__st", _stats_array(vector_stats(df, col)))

    def f(x, i):
        s = F.col("__st")[i]
        z = F.when(s["max"] == s["min"], F.lit(0.0)).otherwise((x - s["min"]) / (s["max"] - s["min"]))
        return z * F.lit(hi - lo) + F.lit(lo)

    return st.withColumn(out, F.transform(dense(col), f)).drop("__st")


def scale_features(df: DataFrame, col: str, out: str, method: str = "MaxMin", sparse: bool = False) -> DataFrame:
    """MaxMin / Standard (no centering for sparse) / Raw."""
    if method == "MaxMin":
        return minmax_scale(df, col, out)
    if method == "Standard":
        return standard_scale(df, col, out, center=not sparse, scale=True)
    if method == "Raw":
        return df.withColumn(out, dense(col))
    raise ValueError(f"Unknown scaling {method}")


def drop_constant(df: DataFrame, col: str, out: str) -> DataFrame:
    """Drop positions holding one value in every row (NaN is an error); keep order of the rest."""
    st = vector_stats(df, col)
    keep = st.agg(
        checked(
            F.array_sort(F.collect_list(F.when(F.col("min") != F.col("max"), F.col("pos")))),
            F.count_if(F.isnan("min") | F.isnan("max")) == 0,
            "NaN feature value",
        ).alias("k")
    ).scalar()
    return df.withColumn("__k", keep).withColumn(out, F.transform("__k", lambda i: dense(col)[i])).drop("__k")


def binarize_dense(col: str) -> Column:
    """Non-zero -> 1 (negatives included), zero -> 0."""
    return F.transform(dense(col), lambda x: F.when(x != 0, F.lit(1.0)).otherwise(F.lit(0.0)))


def binarize_sparse(val: str) -> Column:
    """Sparse form: > 0 -> 1, otherwise 0."""
    return F.when(F.col(val) > 0, F.lit(1.0)).otherwise(F.lit(0.0))


def fold_dense(col: str, size: int = 512) -> Column:
    """Sum values at index mod ``size`` (always folds, like the Spark-side folder); values must stay >= 0."""
    a = dense(col)
    n = F.size(a)
    folded = F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda j: F.when(j >= n, F.lit(0.0)).otherwise(
            F.aggregate(F.sequence(j, F.greatest(n - 1, j), F.lit(size)), F.lit(0.0), lambda acc, i: acc + F.coalesce(a[i], F.lit(0.0)))
        ),
    )
    return checked(folded, F.forall(folded, lambda v: v >= 0), "Folded value must be positive")


def fold_sparse(long: DataFrame, id_cols: Sequence[str], idx: str, val: str, size: int = 512) -> DataFrame:
    """Sparse fold: ``groupBy(id, pmod(idx, size)).sum`` (negative indices fold into range)."""
    return long.groupBy(*id_cols, F.pmod(F.col(idx), F.lit(size)).alias(idx)).agg(F.sum(val).alias(val))


def vector_slice(col: str, indices: Sequence[int]) -> Column:
    """Keep chosen positions, renumbered 0..k-1."""
    return F.array(*[dense(col)[i] for i in indices])


def argmax(col: str) -> Column:
    """0-based index of the largest element (first on ties)."""
    a = dense(col)
    return (F.array_position(a, F.array_max(a)) - 1).cast("long")


# ---------------------------------------------------------- text features

def shingles(text: Column, n: int = 3) -> Column:
    """Character n-grams of a text (the whole text, not a prefix)."""
    t = text
    return F.when(F.length(t) < n, F.array(t)).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, n))
    )


def words(text: Column) -> Column:
    """Lower-cased Unicode word tokens of the whole text."""
    return F.filter(word_split(text), lambda w: w != "")


def word_split(text: Column) -> Column:
    """Split on non-letter/digit runs (may hold empty strings at the ends; explode then filter them as rows,
    which keeps the hot path in whole-stage codegen)."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def feature_counts(df: DataFrame, id_col: str, tokens: Column, name: str = "feature") -> DataFrame:
    """(id, feature, count) -- the sparse count-vector in exploded form.

    Input should be partitioned by ``id_col`` (``repartition(id)``) so that the
    per-(id, feature) count needs no further shuffle.
    """
    return df.select(id_col, F.explode(tokens).alias(name)).groupBy(id_col, name).agg(F.count(F.lit(1)).cast("double").alias("count"))


def fingerprint(df: DataFrame, id_col: str, text: str, n: int = 3, size: int = 1024) -> DataFrame:
    """Hashed character n-gram count vector, folded to ``size`` (sparse exploded form)."""
    h = F.pmod(F.xxhash64(F.col("feature")), F.lit(size)).cast("int")
    counts = feature_counts(df, id_col, shingles(F.col(text), n))
    return counts.groupBy(id_col, h.alias("idx")).agg(F.sum("count").alias("val"))


def hash_index(long: DataFrame, feature: str) -> DataFrame:
    """Dictionary of all features in a dataset -> dense sequential index (ordered by feature)."""
    from assayflow.operators.ordered import add_position

    return add_position(long.select(feature).distinct(), [feature], (), "index")


def word_vectors(df: DataFrame, id_col: str, tokens: str, name: str = "features") -> DataFrame:
    """``df`` with the sparse vector of each row's word counts over all words of ``df``, however many there are.

    The dictionary is a table joined to the counts; only its size reaches the driver.  ``id_col`` is unique.
    """
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import StructField, StructType

    counts = feature_counts(df, id_col, F.col(tokens), "__word")
    words_ = hash_index(counts, "__word")
    size = words_.count()
    entry = F.struct(F.col("index").cast("int").alias("i"), F.col("count").alias("c"))
    rows = counts.join(words_, "__word").groupBy(F.col(id_col).alias("__id")).agg(F.sort_array(F.collect_list(entry)).alias("__at"))
    at = F.coalesce("__at", F.array().cast("array<struct<i:int,c:double>>"))
    # a vector column is stored as this struct; reading it back as vectors needs no Python
    stored = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).cast("int").alias("size"), at["i"].alias("indices"), at["c"].alias("values"))
    out = df.join(rows, F.col(id_col) == F.col("__id"), "left").select(*df.columns, stored.alias(name))
    path = scratch_dir(df.sparkSession, "vectors")
    out.write.parquet(path)
    return df.sparkSession.read.schema(StructType([*df.schema.fields, StructField(name, VectorUDT())])).parquet(path)


def descriptors(text: Column) -> Column:
    """Fixed-width numeric descriptor vector of a text; any null element -> null vector."""
    arr = F.array(
        F.length(text).cast("double"),
        F.size(words(text)).cast("double"),
        F.regexp_count(text, F.lit(r"\n")).cast("double"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("double"),
        F.regexp_count(text, F.lit(r"\p{N}")).cast("double"),
        F.regexp_count(text, F.lit(r"[.!?]")).cast("double"),
    )
    return F.when(F.exists(arr, lambda x: x.isNull()), F.lit(None)).otherwise(arr)


def idf_weights(doc_terms: DataFrame, doc_col: str, term_col: str) -> DataFrame:
    """weight = log10(vocabulary size / document frequency) -- vocabulary size, not document count."""
    df_ = doc_terms.select(doc_col, term_col).distinct().groupBy(term_col).agg(F.count(F.lit(1)).alias("df"))
    vocab = df_.agg(F.count(F.lit(1)).alias("v")).scalar()
    return df_.withColumn("idf", F.log10(vocab / F.col("df")))


def assemble(df: DataFrame, cols: Sequence[str], out: str) -> DataFrame:
    """Feature array from named numeric columns; a null fails the job."""
    arr = F.array(*[F.col(c).cast("double") for c in cols])
    return df.withColumn(out, checked(arr, ~F.exists(arr, lambda x: x.isNull()), "null value in feature columns"))


def word_document_frequency(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Vocabulary with document frequency (word, df)."""
    return docs.select(id_col, F.explode(F.array_distinct(words(F.col(text)))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def idf_score(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Per document: sum over word occurrences of log10(vocabulary size / document frequency)."""
    occ = docs.select(id_col, F.explode(words(F.col(text))).alias("word"))
    w = idf_weights(occ, id_col, "word")
    return occ.join(w, "word").groupBy(id_col).agg(F.sum("idf").alias("weight"))


def base_table(long: DataFrame, key: str, title: str, responses: Sequence[str]) -> DataFrame:
    """Ingest builder: key, title and, per recipe response, its text column and numeric column.
    A response with no values at all fails the job, whichever columns are read."""
    g = long.groupBy(key, title).agg(
        *[F.max(F.when(F.col("response") == r, F.col("raw"))).alias(r) for r in responses],
        *[F.max(F.when(F.col("response") == r, F.col("value"))).alias(f"{r}_value") for r in responses],
    )
    n = long.agg(*[F.count(F.when(F.col("response") == r, F.col("raw"))).alias(r) for r in responses])
    g = with_row(g, n.select(F.struct(*[F.col(r) for r in responses]).alias("__n")))  # one row with the counts of all fields
    for r in responses:
        for c in (key, r):
            g = g.withColumn(c, checked(F.col(c), F.col("__n")[r] > 0, f"recipe field {r} has no values"))
    return g.drop("__n")


def drop_constant_sparse(long: DataFrame, id_col: str, idx: str, val: str, n_rows: Column) -> DataFrame:
    """Sparse form: drop indices holding one value in every row (implicit zeros included; NaN is an error)
    and renumber the kept indices densely in index order.  ``n_rows`` is the number of vectors."""
    from assayflow.operators.ordered import add_position

    st = long.groupBy(idx).agg(F.count(val).alias("__nz"), F.min(val).alias("__mn"), F.max(val).alias("__mx"),
                               F.count_if(F.isnan(val)).alias("__nan"), F.first(n_rows).alias("__n"))
    constant = F.when(F.col("__nz") < F.col("__n"), (F.col("__mn") == 0) & (F.col("__mx") == 0)).otherwise(F.col("__mn") == F.col("__mx"))
    keep = st.filter(checked(~constant, F.col("__nan") == 0, "NaN feature value")).select(idx)
    renum = add_position(keep, [idx], (), "__new")
    return long.join(renum, idx).select(id_col, F.col("__new").cast("int").alias(idx), val)
