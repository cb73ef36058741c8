"""Empty tables, very long texts, clashing column names and null ids, operator by operator."""

import random

import pytest
from pyspark.sql import functions as F

from harvestlake.llm import decontam, jaccard, mixing, pagediff, queries, quotes, repeats, tokens, warc
from harvestlake.session import fresh_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
NAMES = ("p", "rate", "_h", "h", "copies", "n_tokens", "root", "th", "sid", "n", "tok", "payload", "digest", "key", "_text", "_leaks", "words", "level", "position", "g", "a", "raw", "body")


def clash(df):
    for c in NAMES:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(f"own {c}"))
    return df


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(41)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 8)))
    texts = [" ".join(word() for _ in range(40)) for _ in range(12)] + [None, "", " ", "x" * 300_000, " ".join(word() for _ in range(60_000))]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, texts[0], "en", "s", 0), (None, None, None, None, None), rows[1], rows[1]]
    return spark.createDataFrame(rows, DOCS)


def by_row(df, skip=()):
    return sorted(str([v for c, v in sorted(r.asDict().items()) if c not in skip]) for r in df.collect())


def cases(spark):
    vocabulary = queries.VOCABULARY
    labels = spark.createDataFrame([(i, "x" if i % 2 else "y") for i in range(10)], "doc_id bigint, domain string")
    items = spark.createDataFrame([(1, "one two three four five six seven")], "item_id bigint, text string")
    return {
        "op1": lambda d: mixing.mix(d, labels, {"x": 0.5, "y": 0.5}),
        "op4": lambda d: tokens.count_tokens(d, vocabulary),
        "op7": lambda d: repeats.report_repeats(d, 40),
        "op9": lambda d: decontam.find_leaks(d.drop("_leaks"), items).select("doc_id", "_leaks"),
        "op10": lambda d: jaccard.join_components(d),
    }


@pytest.mark.parametrize("name", ["op1", "op4", "op7", "op9", "op10"])
def test_documents(spark, docs, name):
    run = cases(spark)[name]
    plain = run(docs)
    assert by_row(run(clash(docs))) == by_row(plain)
    assert plain.count() == docs.count()
    assert run(docs.limit(0)).count() == 0


def test_pages(spark):
    rows = [(i, f"http://h/p/{i}", f"<article><p>page {i}</p></article>") for i in range(5)]
    rows += [(7, "http://h/long", "<article>" + "<p>line of a very long page</p>" * 20_000 + "</article>"), (8, None, "x" * 3_000_000), (None, "http://h/n", None), rows[0]]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    text = pagediff.extract_text(pages)
    assert by_row(pagediff.extract_text(clash(pages))) == by_row(text)
    assert {r.page_id: r.n_chars for r in text.collect()}[7] == 20_000 * len("line of a very long page\n") - 1
    out = []
    for p in (pages, clash(pages)):
        folder = fresh_path(spark, "warc")
        warc.write_archive(p, folder)
        out.append(by_row(warc.read_archive(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")))
    assert out[0] == out[1] and len(out[0]) == len(rows)
    folder = fresh_path(spark, "warc")
    warc.write_archive(pages.limit(0), folder)
    assert warc.read_archive(spark, folder).count() == 0 and pagediff.extract_text(pages.limit(0)).count() == 0


def test_conversations(spark):
    rows = [(1, 0, "u", "hello " * 60_000), (1, 1, "a", "> " + "hello " * 60_000 + "\nyes"), (2, 0, None, None), (None, None, "u", "")]
    talk = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    linked = quotes.link_quotations(talk)
    assert by_row(quotes.link_quotations(clash(talk).drop("position"))) == by_row(linked)
    assert {(r.conv_id, r.turn): r.n_linked for r in linked.collect()}[1, 1] == 1
    assert quotes.link_quotations(talk.limit(0)).count() == 0


def test_op1_sums_up_only_words_of_the_model(spark):
    """Words outside the model are no rows of the aggregate; empty, null and repeated rows keep their counts."""
    docs = spark.createDataFrame([(1, "aa  bb\tcc bb"), (1, "aa  bb\tcc bb"), (2, ""), (3, None), (4, "   "), (None, "cc cc"), (5, "dd")], "doc_id long, text string")
    model = spark.createDataFrame([("bb", 1.0, -1.0)], "term string, w_0 double, w_1 double")
    out = mixing.posteriors(docs, model, {"a": -0.5, "b": -0.9})
    got = {r["doc_id"]: (r["copies"], r["n_tokens"], r["p"]) for r in out.collect()}
    even = [0.599, 0.401]
    assert got == {1: (2, 4, [0.988, 0.012]), 2: (1, 0, even), 3: (1, 0, even), 4: (1, 0, even), 5: (1, 1, even), None: (1, 2, even)}
    aggregates = out._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[1]
    assert "isnotnull" in aggregates.split("Join")[0]
