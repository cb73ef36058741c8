"""The registered queries of this subpackage, and SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestlake.llm import dawg, decontam, jaccard, ledger, mixing, pagediff, quotes, repeats, spotsigs, tokens, toxicity, warc, whitening
from harvestlake.llm.common import table
from harvestlake.session import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Shares of all tokens that the mixture is to have.
TARGETS = {"good": 0.90, "junk": 0.08, "toxic": 0.02}
#: Vocabulary file of a public tokenizer; any other of the kind will do.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@register("op1_mix_sources")
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents for the target shares of the label table's domains."""
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.label_domains(table(spark, sf_dir, "labels")), TARGETS)


@register(
    "op2_warc_archive",
    """
    WITH facts AS (
      SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS hex FROM pages
    ), firsts AS (SELECT hex, min(page_id) AS first_id FROM facts GROUP BY hex)
    SELECT page_id, cast(octet_length(body) AS bigint) AS payload_bytes,
           translate(array_to_string(list_transform([0, 1, 2, 3], lambda k: to_base(cast('0x' || substr(hex, 1 + 10 * k, 10) AS bigint), 32, 8)), ''),
                     '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
           CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first_id THEN first_id END AS refers_to
    FROM facts JOIN firsts USING (hex)
    """,
)
def warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived, then read back."""
    folder = fresh_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), folder, min_bytes=0)
    return warc.read_archive(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register(
    "op3_page_text",
    r"""
    WITH blocks AS (
      SELECT page_id, url, list_filter(list_transform(
        regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?(?:p|h1|br)>'),
        lambda b: trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(b, '<[^>]*>', '', 'g'),
             '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#39;', ''''), '&amp;', '&'), '&amp', '&'), '\s+', ' ', 'g'))), lambda b: b <> '') AS b
      FROM pages)
    SELECT page_id, url, array_to_string(b, chr(10)) AS text, cast(length(array_to_string(b, chr(10))) AS bigint) AS n_chars FROM blocks
    """,
)
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return pagediff.extract_text(table(spark, sf_dir, "pages"))


@register("op4_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents."""
    return tokens.count_tokens(table(spark, sf_dir, "documents"), VOCABULARY)


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@register(
    "op5_quality_ledger",
    rf"""
    WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
    win AS (SELECT k, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT k, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
    twice AS (SELECT k, g FROM win GROUP BY k, g HAVING count(*) > 1),
    rep AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(i, i + 8)) AS p FROM win JOIN twice USING (k, g)) GROUP BY k),
    lines AS (SELECT k, unnest(string_split(t, chr(10))) AS l FROM d),
    dup AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY k),
    m AS (SELECT doc_id, cast(len(w) AS bigint) AS n_words, cast(length(array_to_string(w, '')) AS bigint) AS word_chars,
                 cast(length(t) - length(translate(t, '#*$%&|<>', '')) AS bigint) AS n_symbols,
                 cast(coalesce(dup.n, 0) AS bigint) AS n_dup_lines, cast(coalesce(rep.n, 0) AS bigint) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
                 length(regexp_replace(t, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(t, '[^a-z]', '', 'g')) AS low,
                 len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS stutter
          FROM d LEFT JOIN dup USING (k) LEFT JOIN rep USING (k))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
           NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 25 * n_words OR up > low
                OR (n_lines >= 4 AND 100 * n_dup_lines > 60 * n_lines) OR 2 * stutter > n_words) AS kept
    FROM m
    """,
)
def quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents, judged by its base rules and by policy v1."""
    book = ledger.ledger(table(spark, sf_dir, "documents"))
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ledger.fails("base").alias("base_failed"), (~ledger.fails("v1")).alias("kept"),
    )


@register(
    "op6_quotation_links",
    """
    WITH c AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations)
    SELECT conv_id, turn, position, role, CASE WHEN turn > 0 THEN turn - 1 END AS reply_to,
           cast(least(turn, 2) AS bigint) AS n_quoted, cast(least(turn, 2) AS bigint) AS n_linked, trim(text) AS text
    FROM c
    """,
)
def quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, written as mail that quotes two levels deep, linked and unquoted again."""
    return quotes.link_quotations(quotes.as_mail(table(spark, sf_dir, "conversations")))


@register("op7_repeated_bytes")
def repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What 400-byte repeats take from all documents."""
    return repeats.report_repeats(table(spark, sf_dir, "documents"), length=400)


@register("op8_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a grammar learned from labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")), threshold=0.7)


@register("op9_benchmark_leaks")
def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the benchmark items they hold."""
    found = decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        (F.size("_leaks") > 0).alias("contaminated"),
        F.transform("_leaks", lambda x: x["item_id"]).alias("item_ids"),
        F.coalesce(F.array_max(F.transform("_leaks", lambda x: x["share"])), F.lit(0.0)).alias("best_share"),
    )


_FOLDED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


@register(
    "op10_shingle_components",
    rf"""
    WITH RECURSIVE d AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    link AS (SELECT a, b FROM inter JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
    both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
    reach AS (SELECT doc_id AS node, doc_id AS seen FROM d UNION SELECT node, b FROM reach JOIN both_ways ON a = seen)
    SELECT doc_id, cast(coalesce(n, 0) AS bigint) AS n_shingles, min(seen) AS component_id
    FROM d JOIN reach ON node = doc_id LEFT JOIN n USING (doc_id) GROUP BY doc_id, n
    """,
)
def shingle_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents linked by three-word shingles at 0.9."""
    return jaccard.join_components(table(spark, sf_dir, "documents"), width=3, percent=90)


@register("op11_whitened_components")
def whitened_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the four leading components of their covariance, whitened."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), count=4)


@register("op12_spot_signatures")
def spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return spotsigs.fingerprint_edits(table(spark, sf_dir, "documents"))


@register("op13_conversation_repair")
def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged, with their faults and cheapest repair."""
    return dawg.repair(table(spark, sf_dir, "conversations"))
