"""§2.12 feature-transformer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayflow.operators import features as FT
from assayflow.plans.inputs import Tables
from assayflow.plans.q_metrics import r6
from assayflow.plans.registry import query

EMB_LONG = "el AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(generate_series(0, len(embedding) - 1)) AS pos FROM embeddings)"


@query("feat_assemble", "SELECT c_custkey, CAST(c_acctbal AS DOUBLE) AS f0, CAST(c_nationkey AS DOUBLE) AS f1 FROM customer")
def q_assemble(spark, sf):
    c = FT.assemble(Tables(spark, sf).customer, ["c_acctbal", "c_nationkey"], "features")
    return c.select("c_custkey", F.col("features")[0].alias("f0"), F.col("features")[1].alias("f1"))


@query("feat_drop_constant", """SELECT vec_id, CAST(unnest(range(0, len(embedding) + 1)) AS INTEGER) AS pos, round(unnest(list_append(CAST(embedding AS DOUBLE[]), CAST(label AS DOUBLE))), 6) AS value FROM embeddings""")
def q_drop_constant(spark, sf):
    e = Tables(spark, sf).embeddings.select("vec_id", F.concat(F.col("embedding").cast("array<double>"), F.array(F.lit(1.0), F.col("label").cast("double"))).alias("v"))
    d = FT.drop_constant(e, "v", "kept")
    return d.select("vec_id", F.posexplode("kept").alias("pos", "value")).select("vec_id", "pos", r6(F.col("value")).alias("value"))


@query("feat_fold", f"WITH {EMB_LONG} SELECT vec_id, CAST(pos % 10 AS INTEGER) AS pos, round(sum(abs(v)), 6) AS value FROM el GROUP BY vec_id, pos % 10")
def q_fold(spark, sf):
    e = Tables(spark, sf).embeddings.select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: F.abs(x)).alias("a"))
    f = e.select("vec_id", FT.fold_dense("a", 10).alias("f"))
    return f.select("vec_id", F.posexplode("f").alias("pos", "value")).select("vec_id", "pos", r6(F.col("value")).alias("value"))


BW_SQL = r"""bw AS (SELECT item_id AS id, w AS word, CAST(count(*) AS DOUBLE) AS cnt FROM (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS w FROM benchmark) WHERE w <> '' GROUP BY ALL)"""
WORDS_DICT = r"""bw AS (SELECT item_id AS id, w AS word, CAST(count(*) AS DOUBLE) AS cnt FROM (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS w FROM benchmark) WHERE w <> '' GROUP BY ALL),
dict AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS idx FROM (SELECT DISTINCT word FROM bw))"""


def _bench_words(t):
    return FT.feature_counts(t.benchmark.repartition("item_id"), "item_id", FT.words(F.col("text")), "word")


@query("feat_hash_index", f"WITH {WORDS_DICT} SELECT word, idx AS index FROM dict")
def q_hash_index(spark, sf):
    return FT.hash_index(_bench_words(Tables(spark, sf)), "word").withColumnRenamed("word", "word")


@query("feat_fold_sparse", f"WITH {WORDS_DICT} SELECT bw.id AS item_id, CAST(idx % 512 AS INTEGER) AS idx, sum(cnt) AS val FROM bw JOIN dict ON bw.word = dict.word GROUP BY ALL")
def q_fold_sparse(spark, sf):
    t = Tables(spark, sf)
    w = _bench_words(t)
    d = FT.hash_index(w, "word")
    long = w.join(d, "word").select("item_id", F.col("index").cast("int").alias("idx"), F.col("count").alias("val"))
    return FT.fold_sparse(long, ["item_id"], "idx", "val", 512)


@query("agg_vec_stats_sparse", f"""WITH {WORDS_DICT}, n AS (SELECT count(*) AS n FROM benchmark),
st AS (SELECT dict.idx, count(*) AS nz, sum(cnt) AS s, sum(cnt * cnt) AS ss, min(cnt) AS mn, max(cnt) AS mx FROM bw JOIN dict ON bw.word = dict.word GROUP BY dict.idx)
SELECT CAST(idx AS INTEGER) AS idx, n AS count, round(s / n, 6) AS mean, CASE WHEN nz < n THEN least(mn, 0.0) ELSE mn END AS min, CASE WHEN nz < n THEN greatest(mx, 0.0) ELSE mx END AS max,
  round(ss / n - (s / n) * (s / n), 6) AS variance, round(sqrt(greatest(ss / n - (s / n) * (s / n), 0.0)), 6) AS sd FROM st, n""")
def q_vec_stats_sparse(spark, sf):
    """Statistics per position of sparse word-count vectors, zeros that are not stored counted."""
    t = Tables(spark, sf)
    w = _bench_words(t)
    long = w.join(FT.hash_index(w, "word"), "word").select(F.col("index").cast("int").alias("idx"), F.col("count").alias("val"))
    s = FT.sparse_vector_stats(long, "idx", "val", t.benchmark.agg(F.count(F.lit(1))).scalar())
    return s.select("idx", "count", r6(F.col("mean")).alias("mean"), "min", "max", r6(F.col("variance")).alias("variance"), r6(F.col("sd")).alias("sd"))


def _emb(t):
    return t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("a"))


def _long(df, col):
    return df.select("vec_id", F.posexplode(col).alias("pos", "value")).select("vec_id", "pos", r6(F.col("value")).alias("value"))


@query("feat_standard_scale", f"""WITH {EMB_LONG}, s AS (SELECT pos, avg(v) AS m, stddev_pop(v) AS sd FROM el GROUP BY pos)
SELECT vec_id, CAST(el.pos AS INTEGER) AS pos, round(CASE WHEN sd > 0 THEN (v - m) / sd ELSE v - m END, 6) AS value FROM el JOIN s ON el.pos = s.pos""")
def q_standard_scale(spark, sf):
    s = FT.standard_scale(_emb(Tables(spark, sf)), "a", "z", center=True, scale=True)
    return _long(s, "z")


@query("feat_minmax_scale", f"""WITH {EMB_LONG}, s AS (SELECT pos, min(v) AS mn, max(v) AS mx FROM el GROUP BY pos)
SELECT vec_id, CAST(el.pos AS INTEGER) AS pos, round(CASE WHEN mx = mn THEN 0.0 ELSE (v - mn) / (mx - mn) END, 6) AS value FROM el JOIN s ON el.pos = s.pos""")
def q_minmax_scale(spark, sf):
    s = FT.minmax_scale(_emb(Tables(spark, sf)), "a", "z")
    return _long(s, "z")


@query("feat_scale_choice", f"""WITH {EMB_LONG}, s AS (SELECT pos, stddev_pop(v) AS sd FROM el GROUP BY pos)
SELECT vec_id, CAST(el.pos AS INTEGER) AS pos, round(CASE WHEN sd > 0 THEN v / sd ELSE v END, 6) AS value FROM el JOIN s ON el.pos = s.pos""")
def q_scale_choice(spark, sf):
    s = FT.scale_features(_emb(Tables(spark, sf)), "a", "z", "Standard", sparse=True)
    return _long(s, "z")


@query("feat_binarize", f"""WITH {EMB_LONG}, {BW_SQL}
SELECT vec_id AS id, 'dense' AS kind, CAST(sum(CASE WHEN v <> 0 THEN 1 ELSE 0 END) AS DOUBLE) AS ones FROM el GROUP BY vec_id
UNION ALL SELECT id, 'sparse', CAST(sum(CASE WHEN cnt > 0 THEN 1 ELSE 0 END) AS DOUBLE) FROM bw GROUP BY id""")
def q_binarize(spark, sf):
    t = Tables(spark, sf)
    d = _emb(t).select(F.col("vec_id").alias("id"), F.lit("dense").alias("kind"), F.aggregate(FT.binarize_dense("a"), F.lit(0.0), lambda s, x: s + x).alias("ones"))
    sp = _bench_words(t).groupBy(F.col("item_id").alias("id")).agg(F.sum(FT.binarize_sparse("count")).alias("ones")).select("id", F.lit("sparse").alias("kind"), "ones")
    return d.unionByName(sp)


@query("feat_fingerprint", "SELECT item_id, CAST(greatest(length(text) - 2, 1) AS DOUBLE) AS total FROM benchmark")
def q_fingerprint(spark, sf):
    t = Tables(spark, sf)
    fp = FT.fingerprint(t.benchmark.repartition("item_id"), "item_id", "text", n=3, size=1024)
    return fp.groupBy("item_id").agg(F.sum("val").alias("total"))


@query("feat_descriptors", r"""SELECT doc_id, CAST(length(text) AS DOUBLE) AS n_chars, CAST(len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS DOUBLE) AS n_words,
  CAST(len(regexp_extract_all(text, '\n')) AS DOUBLE) AS n_lines, CAST(len(regexp_extract_all(text, '\p{Lu}')) AS DOUBLE) AS n_upper,
  CAST(len(regexp_extract_all(text, '\p{N}')) AS DOUBLE) AS n_digits, CAST(len(regexp_extract_all(text, '[.!?]')) AS DOUBLE) AS n_punct FROM documents""")
def q_descriptors(spark, sf):
    d = Tables(spark, sf).documents.select("doc_id", FT.descriptors(F.col("text")).alias("d"))
    names = ["n_chars", "n_words", "n_lines", "n_upper", "n_digits", "n_punct"]
    return d.select("doc_id", *[F.col("d")[i].alias(n) for i, n in enumerate(names)])


@query("feat_wordcount", r"""SELECT w AS word, count(DISTINCT item_id) AS df FROM (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS w FROM benchmark) WHERE w <> '' GROUP BY 1""")
def q_wordcount(spark, sf):
    return FT.word_document_frequency(Tables(spark, sf).benchmark, "item_id", "text")


@query("feat_idf", r"""WITH o AS (SELECT item_id, w FROM (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS w FROM benchmark) WHERE w <> ''),
d AS (SELECT w, count(DISTINCT item_id) AS df FROM o GROUP BY 1), v AS (SELECT count(*) AS v FROM d)
SELECT item_id, round(sum(log10(v.v / d.df)), 6) AS weight FROM o JOIN d ON o.w = d.w, v GROUP BY item_id""")
def q_idf(spark, sf):
    s = FT.idf_score(Tables(spark, sf).benchmark, "item_id", "text")
    return s.select("item_id", r6(F.col("weight")).alias("weight"))


@query("feat_base_table", "SELECT p_partkey AS key, p_name AS title, CAST(p_size AS VARCHAR) AS p_size, round(log10(p_size), 6) AS p_size_value, p_type, CAST(NULL AS DOUBLE) AS p_type_value, CAST(p_retailprice AS VARCHAR) AS p_retailprice, round(p_retailprice, 6) AS p_retailprice_value FROM part")
def q_base_table(spark, sf):
    from assayflow.plans.q_io import RECIPE, _records
    from assayflow.sources import tables as IO

    r = _records(spark, sf).select(F.col("fields")["p_partkey"].cast("bigint").alias("key"), "title", "fields")
    recipe = spark.createDataFrame([(x["file"], x["response"], x["category"], x["transform"]) for x in RECIPE],
                                   "file string, response string, category string, transform string")
    long = IO.apply_recipe(r.select("key", "fields"), "key", recipe, "part").join(r.select("key", "title"), "key")
    b = FT.base_table(long, "key", "title", [x["response"] for x in RECIPE if x["file"] == "part"])
    return b.select("key", "title", "p_size", r6(F.col("p_size_value")).alias("p_size_value"), "p_type", "p_type_value", "p_retailprice", r6(F.col("p_retailprice_value")).alias("p_retailprice_value"))


@query("feat_nominal", """WITH f AS (SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS a, c_acctbal AS b, CAST(c_mktsegment = 'BUILDING' AS DOUBLE) AS c, CAST(c_nationkey % 3 * 7 + 2 AS DOUBLE) AS d FROM customer),
n AS (SELECT count(DISTINCT a) AS na, count(DISTINCT b) AS nb, count(DISTINCT c) AS nc, count(DISTINCT d) AS nd FROM f)
SELECT c_custkey, CAST(CASE WHEN na > 4 THEN a ELSE dense_rank() OVER (ORDER BY a) - 1 END AS DOUBLE) AS nation, CAST(CASE WHEN nb > 4 THEN b ELSE dense_rank() OVER (ORDER BY b) - 1 END AS DOUBLE) AS balance,
  CAST(CASE WHEN nc > 4 THEN c ELSE dense_rank() OVER (ORDER BY c) - 1 END AS DOUBLE) AS building, CAST(CASE WHEN nd > 4 THEN d ELSE dense_rank() OVER (ORDER BY d) - 1 END AS DOUBLE) AS third FROM f, n""")
def q_nominal(spark, sf):
    """Positions with at most 4 distinct values become categorical (MLlib VectorIndexer)."""
    from pyspark.ml.feature import VectorIndexer

    c = Tables(spark, sf).customer.select("c_custkey", F.array(F.col("c_nationkey").cast("double"), F.col("c_acctbal"), (F.col("c_mktsegment") == "BUILDING").cast("double"),
                                                               (F.col("c_nationkey") % 3 * 7 + 2).cast("double")).alias("a"))
    v = c.select("c_custkey", FT.to_ml_vector("a").alias("features"))
    from pyspark.ml.functions import vector_to_array

    m = VectorIndexer(maxCategories=4, inputCol="features", outputCol="indexed").fit(v)
    indexed = m.transform(v).select("c_custkey", vector_to_array("indexed").alias("i"))
    return indexed.select("c_custkey", *[F.col("i")[k].alias(name) for k, name in enumerate(("nation", "balance", "building", "third"))])


@query("feat_svd_gram", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), x AS (SELECT vec_id, unnest(range(1, len(v) + 1)) AS p, unnest(v) AS y FROM e)
SELECT CAST(a.p - 1 AS INTEGER) AS i, CAST(b.p - 1 AS INTEGER) AS j, round(sum(a.y * b.y), 4) AS value FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.p <= b.p GROUP BY a.p, b.p""")
def q_svd_gram(spark, sf):
    """The sums of products behind the singular vectors, added up from batches by position."""
    from assayflow.operators.kernels import gramian

    sums, _ = gramian(_emb(Tables(spark, sf)), "a")
    return sums.select("i", "j", F.round("value", 4).alias("value"))


@query("feat_svd")
def q_svd(spark, sf):
    """Projection of the embeddings onto their first 10 right singular vectors (uncentered, Gram sums from all tasks)."""
    from assayflow.operators.models import svd_project

    return svd_project(_emb(Tables(spark, sf)), "vec_id", "a", k=10)


@query("feat_pca")
def q_pca(spark, sf):
    """PCA (k=10) of the embeddings inside a pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    e = _emb(Tables(spark, sf)).select("vec_id", FT.to_ml_vector("a").alias("features"))
    m = Pipeline(stages=[PCA(k=10, inputCol="features", outputCol="pca")]).fit(e)
    return m.transform(e).select("vec_id", vector_to_array("pca").alias("pca"))


@query("feat_drop_constant_sparse", f"""WITH {WORDS_DICT}, n AS (SELECT count(*) AS n FROM benchmark),
st AS (SELECT bw.word, count(*) AS nz, min(cnt) AS mn, max(cnt) AS mx FROM bw GROUP BY 1),
kept AS (SELECT st.word FROM st, n WHERE NOT (CASE WHEN nz < n.n THEN mn = 0 AND mx = 0 ELSE mn = mx END)),
re AS (SELECT kept.word, row_number() OVER (ORDER BY dict.idx) - 1 AS idx FROM kept JOIN dict ON kept.word = dict.word)
SELECT bw.id AS item_id, CAST(re.idx AS INTEGER) AS idx, bw.cnt AS val FROM bw JOIN re ON bw.word = re.word""")
def q_drop_constant_sparse(spark, sf):
    """Sparse word-count vectors of the benchmark with constant dictionary positions dropped and renumbered."""
    t = Tables(spark, sf)
    w = _bench_words(t)
    d = FT.hash_index(w, "word")
    long = w.join(d, "word").select("item_id", F.col("index").cast("int").alias("idx"), F.col("count").alias("val"))
    n = t.benchmark.agg(F.count(F.lit(1))).scalar()
    return FT.drop_constant_sparse(long, "item_id", "idx", "val", n)
