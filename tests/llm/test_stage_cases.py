"""The pipeline's stages on clashing column names, null ids and texts, passages in words, and an empty table."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from harvestlake.llm import repeats
from harvestlake.llm.common import BATCH_BYTES, BATCH_SETTING
from harvestlake.session import fresh_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
NAMES = ("h", "_kept", "_copy", "_id", "_th", "_leaks", "_h", "row", "own", "copy", "kept", "one", "failures", "n_words", "rate.x")


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else "".join(rng.choice("bdfklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark):
    rng = random.Random(31)
    texts = [prose(rng, rng.randrange(80, 160)) for _ in range(40)]
    passages = [prose(rng, 52) for _ in range(6)]
    for k, p in enumerate(passages):
        for i in (2 * k, 2 * k + 1):
            w = texts[i].split()
            texts[i] = " ".join(w[:30]) + f" {p} " + " ".join(w[30:])
    item = prose(rng, 40)
    texts.append(prose(rng, 60) + " " + item)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(None, prose(rng, 90), "en", "s", 0), (100, None, None, None, None), (None, None, "en", "s", 0), (101, "", "en", "s", 0), (102, prose(rng, 60_000), "en", "s", 0)]
    rows += [rows[20], rows[20]]
    at = fresh_path(spark, "stage-cases")
    docs = spark.createDataFrame(rows, DOCS)
    for c in NAMES:
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    docs.write.parquet(f"{at}/documents.parquet")
    docs.limit(0).write.parquet(f"{at}/none.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(30)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, texts, passages


def test_stages_keep_columns_and_rows(spark, folder):
    at, texts, passages = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = fresh_path(spark, name)
        stage(spark, docs, at).write.parquet(out)
        docs = spark.read.parquet(out)
        if name != "mix_sources":
            assert docs.columns == columns, name
            assert all(r[c] == f"own {c}" for r in docs.collect() for c in NAMES)
        kept.append(docs.collect())
    ids = [sorted(str(r["doc_id"]) for r in k) for k in kept]
    assert ids[0].count("None") == 1 and ids[0].count("20") == 3 and "100" not in ids[0] and "102" in ids[0]
    assert ids[1] == sorted({*ids[0]}) and "40" in ids[2] and "40" not in ids[3]
    left = {r["doc_id"]: r["text"] for r in kept[2]}
    for k, p in enumerate(passages):
        assert all(p not in left[i] and len(left[i]) > len(texts[i]) - len(p) - 6 for i in (2 * k, 2 * k + 1)), k
    assert all(left[i] == texts[i] for i in range(12, 40))
    assert {r["off_good"] for r in kept[4]} and len(kept[4]) == len(kept[3])


def test_stages_of_an_empty_table(spark, folder):
    at, *_ = folder
    docs = spark.read.parquet(f"{at}/none.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, at).count() == 0, name


def test_runs_are_counted_in_words(spark):
    rng = random.Random(33)
    long, short = prose(rng, 50), prose(rng, 49)
    texts = [f"{prose(rng, 20)} {p} {prose(rng, 20)}" for p in (long, short, long, short)] + [short, short]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    left = {r["doc_id"]: r for r in repeats.remove_repeats(docs, 100, n_chars="n_chars", min_words=50).collect()}
    assert [long in left[i]["text"] for i in (0, 2)] == [False, False] and left[0]["n_chars"] == len(left[0]["text"])
    assert [left[i]["text"] for i in (1, 3, 4, 5)] == [texts[i] for i in (1, 3, 4, 5)]


def test_texts_go_to_python_in_bounded_batches(spark):
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 800).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(4000).alias("n_chars"))
    before = spark.conf.get(BATCH_SETTING, None)
    try:
        for own, most in ((None, BATCH_BYTES), ("100000", 100_000)):
            spark.conf.unset(BATCH_SETTING) if own is None else spark.conf.set(BATCH_SETTING, own)
            assert corpus_pipeline.quality_rules(spark, docs, "").count() == 0  # repeated words only
            assert 0 < max(r.n for r in docs.select("text").mapInArrow(sizes, "n bigint").collect()) <= most + 8192
    finally:
        spark.conf.unset(BATCH_SETTING) if before is None else spark.conf.set(BATCH_SETTING, before)


def test_repeats_are_cut_by_one_python_step(spark):
    work = spark.createDataFrame([(b"a", "\u00e4".encode() * 300)], "h binary, raw binary")
    spans = spark.createDataFrame([(b"a", 1, 10)], "h binary, lo int, hi int")
    cut = repeats._cut_texts(work, spans, 100, decode=True).where("n_removed > 0").select("h", "kept")
    assert cut._jdf.queryExecution().executedPlan().initialPlan().toString().count("ArrowEvalPython") == 1
    assert [(r.h, r.kept) for r in cut.collect()] == [(b"a", "\u00e4" * (300 - 55))]
