"""The pipeline's stages on awkward rows: nulls in any column, null and repeated ids, long texts, clashing names, empty tables."""

import random

import pytest

from ..conftest import spark  # noqa: F401

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id long, n long, key string, gone_id long, gone_digest string, words string, piece int"
PROSE = ["The river runs past the old mill and turns to the south.", "Nobody had seen the letter before the morning of the trial.", "A small garden behind the house was full of herbs in June.",
         "She counted the boats twice and wrote the number in her book.", "When the bell rang, the children ran down to the harbour."]


def prose(rng, n=12):
    return " ".join(f"{rng.choice(PROSE)} Note {rng.randint(0, 10**6)}." for _ in range(n))


def tables(spark, folder, rows, labels, items):  # noqa: F811
    extra = (7, 8, "k", 9, "d", "w", 1)
    spark.createDataFrame([(i, t, None if k % 3 else "en", None if k % 4 == 0 else f"s{k % 2}", None, *extra) for k, (i, t) in enumerate(rows)], COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):  # noqa: F811
    rng = random.Random(12)
    good = [(i, prose(rng)) for i in range(1, 60)]
    bad = [(100 + i, "!!! $$ 1 " * rng.randint(30, 80)) for i in range(40)]
    long = " ".join(prose(rng, 40) for _ in range(60))
    passage = "the quick answer to this question is that seven lamps were lit before the guests arrived at noon"
    rows = good + bad + [(200, long), (200, prose(rng)), (None, good[0][1]), (None, prose(rng)), (201, None), (None, None), (202, ""), (203, good[1][1]), (204, good[2][1] + " And one more."),
                         (205, f"{prose(rng)} {passage} {prose(rng)}"), (206, good[3][1]), (206, good[3][1])]
    labels = [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(None, 1, 0), (1, None, 0), (300, 1, None)]
    items = [(1, passage), (2, None), (3, ""), (None, "another passage that is in no document at all, nowhere to be found")]
    return tables(spark, tmp_path_factory.mktemp("awkward"), rows, labels, items), dict(good=good, long=long)


def test_every_stage_takes_awkward_rows(spark, awkward):  # noqa: F811
    import corpus_pipeline as pipeline

    sf, made = awkward
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    whole = [(r["doc_id"], r["text"]) for r in docs.collect()]
    after = {}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == names
        after[name] = [(r["doc_id"], r["text"]) for r in out.collect()]
        assert not set(after[name]) - set(whole)
    kept = after["quality classifier"]
    assert set(made["good"]) <= set(kept) and not [i for i, _ in kept if i is not None and 100 <= i < 140]
    exact = after["exact dedup"]
    assert (203, made["good"][1][1]) in exact and made["good"][1] not in exact  # of equal texts the largest id
    assert exact.count((206, made["good"][3][1])) == whole.count((206, made["good"][3][1])) or exact.count((206, made["good"][3][1])) == 1
    assert (200, made["long"]) in exact and (None, made["good"][0][1]) not in exact
    near = after["n-gram Jaccard join"]
    assert made["good"][2] in near and not [i for i, _ in near if i == 204]
    assert [i for i, t in near if i is None and t is not None]  # null ids link with nothing
    assert not [i for i, _ in after["benchmark decontamination"] if i == 205] and len(after["benchmark decontamination"]) == len(whole) - 1


def test_the_whole_run_on_awkward_rows_and_on_none(spark, awkward, tmp_path):  # noqa: F811
    import corpus_pipeline as pipeline

    sf, _ = awkward
    out = [r.asDict() for r in pipeline.run(spark, sf).collect()]
    assert out and all(r["n_tokens"] <= 2048 for r in out)
    assert not [r for r in out if r["doc_id"] in (204, 205)]
    empty = tables(spark, tmp_path / "none", [], [], [])
    assert pipeline.run(spark, empty).collect() == []
    unlabelled = tables(spark, tmp_path / "plain", [(1, PROSE[0]), (2, None), (3, PROSE[1])], [], [])
    assert isinstance(pipeline.run(spark, unlabelled).collect(), list)
