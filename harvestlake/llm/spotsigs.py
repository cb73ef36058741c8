"""Document fingerprints of spot signatures: chains of content words that follow common words.

A common word (an anchor) before a content word spots it and the content words after it, ``CHAIN`` in all;
anchor and chain are hashed to one signature.  Prose has common words everywhere and they
survive edits, markup and menus, so the set of signatures is a fingerprint of the prose of a text.
The start of a text, a clause or a table cell is an anchor too, so that texts without common words have signatures.

Sets are compared by Jaccard likeness; sets whose sizes rule out the likeness that is asked for are not compared.

Everything is DataFrame functions: a text's words and signatures are arrays on its row.

Defined cases: a null text is empty; an empty text has an empty set and the fingerprint of one, and two
empty sets are equal (likeness 1); a text without a chain has one signature, of its whole text;
repeated rows have equal results; of rows that share an id, the one with the smallest text hash is the
document that others see; a null id comes after all others; an empty table gives an empty result; a single
document is its own next document; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from harvestlake.llm.common import stored

#: Content words of a chain.
CHAIN = 3
#: Bits of an id that one window of neighbours spans.
SPAN = 11

#: Anchors: fixed lists of common words, English, German, French, Spanish; and of Chinese and Japanese characters.
ANCHORS = (
    "the a an of to and in is are was were be been it that this these those for on with as at by from or not but he she they we you his her their its have has had will would can "
    "der die das den dem des ein eine einen einem einer und oder ist sind war zu mit von für auf im in nicht sich es er sie wir ihr auch an als aus bei nach wie dass "
    "le la les un une des du de et ou est sont dans que qui ne pas pour par sur avec au aux ce cette il elle nous vous se sa son ses en "
    "el los las una unos del al y o es son que en no por para con su sus lo como más pero este esta "
    "的 了 是 在 不 和 有 我 の は を に が と で"
).split()

#: Characters that end a clause or a table cell.
BREAKS = list(".!?;:|\n")
#: A word: a break, or a run of letters and digits; characters of scripts without spaces are words of their own.
_ALONE = r"[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]"
_WORD = r"[.!?;:|\n]|[\p{L}\p{M}\p{N}]+"


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` reads it."""
    return F.transform(F.array(value), use)[0]


def signatures(text: Column, anchors: list[str] = ANCHORS) -> Column:
    """Sorted set of 32-bit signatures of a text: a hash of the word before a chain and of the chain's ``CHAIN`` words."""
    common = sorted({*anchors, *BREAKS})

    def spots(words: Column) -> Column:
        content = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: ~F.get(words, i).isin(common))
        return F.when(F.size(words) > 0, _bound(content, lambda at: chains(words, at)))

    def chains(words: Column, at: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(at) - 1), lambda j: (j == 0) | (F.get(at, j) - F.get(at, j - 1) > 1))

        def chain(j: Column) -> Column:
            anchor = F.when(F.get(at, j) > 0, F.get(words, F.get(at, j) - 1)).otherwise("^")
            return F.xxhash64(anchor, *[F.get(words, F.get(at, j + k)) for k in range(CHAIN)]).bitwiseAND(F.lit(0xFFFFFFFF))

        return F.when(F.size(at) > 0, F.transform(starts, chain))

    spaced = F.when(text.rlike(_ALONE), F.regexp_replace(text, f"({_ALONE})", " $1 ")).otherwise(text)
    words = F.regexp_extract_all(F.lower(spaced), F.lit(_WORD), F.lit(0))
    whole = F.when(text == "", F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF))))
    return F.sort_array(F.array_distinct(F.coalesce(_bound(words, spots), whole)))


def fingerprint(signatures_: Column) -> Column:
    """Size and digest of a set: equal exactly for equal sets."""
    return F.concat_ws("-", F.size(signatures_).cast("string"), F.substring(F.sha2(F.array_join(F.transform(signatures_, F.hex), ",").cast("binary"), 256), 1, 32))


def likeness(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """Jaccard likeness of two sets; 0 where their sizes rule out ``at_least``, which saves the comparison."""
    n, m = F.size(a), F.size(b)
    shared = F.size(F.array_intersect(a, b))
    exact = shared / (n + m - shared)
    return F.when((n == 0) & (m == 0), 1.0).when((F.least(n, m) == 0) | (F.least(n, m) < at_least * F.greatest(n, m)), 0.0).otherwise(exact)


def next_ids(ids: DataFrame) -> DataFrame:
    """``id`` and ``next_id`` of every distinct id: the next one in descending order, null last, then the first again.

    Neighbours are found within blocks of ``2^SPAN`` ids, then among block ends, the ends of these, and so on, so no
    window holds more than ``2^SPAN`` rows, however many ids there are.
    """
    ids = ids.select("id")
    level = ids.where("id IS NOT NULL").distinct().select(F.col("id").alias("lo"), F.col("id").alias("hi"))
    # blocks of a level, and for each the greatest id below it, if its parent holds one
    found = None
    for up in range(SPAN, 64 + SPAN, SPAN):
        block = F.lit(0).cast("bigint") if up >= 64 else F.shiftright(F.col("lo"), up)
        here = level.withColumn("block", block).withColumn("below", F.lag("hi").over(W.partitionBy("block").orderBy("lo")))
        if up == SPAN:
            here = stored(here, "neighbours")  # all further levels read the ends of blocks
        links = here.where("below IS NOT NULL").select(F.col("lo").alias("id"), F.col("below").alias("next_id"))
        found = links if found is None else found.unionByName(links)
        level = here.groupBy("block").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("lo", "hi")
    empty = ids.agg(F.count("*").alias("n"), F.count("id").alias("known"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    wrap = empty.where("known > 0").select(F.col("lo").alias("id"), F.when(F.col("n") == F.col("known"), F.col("hi")).alias("next_id"))
    null = empty.where("n > known").select(F.lit(None).cast("bigint").alias("id"), F.col("hi").alias("next_id"))
    return found.unionByName(wrap).unionByName(null)


def _key(c: str) -> list[Column]:
    return [F.coalesce(F.col(c), F.lit(0)).alias("key"), F.col(c).isNull().alias("no_key")]


def edited(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``text``, ``edited`` (its last third replaced by the start of the next document) and the signatures ``next_signatures`` of that document."""
    own = docs.select(*_key("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    third = F.floor(F.char_length("text") / 3).cast("int")
    facts = stored(own.groupBy("key", "no_key").agg(F.max(third).alias("need"), F.min(F.xxhash64("text")).alias("seen")), "document-facts")
    order = next_ids(facts.select(F.when(~F.col("no_key"), F.col("key")).alias("id")))
    # each id with what the document before it wants of it
    wants = order.select(*_key("id"), *[c.alias(n) for c, n in zip(_key("next_id"), ("next_key", "no_next"), strict=True)]).join(facts.select("key", "no_key", "need"), ["key", "no_key"])
    wants = wants.select(F.col("next_key").alias("key"), F.col("no_next").alias("no_key"), F.col("key").alias("for_key"), F.col("no_key").alias("for_none"), "need")
    wants = stored(wants.join(facts.select("key", "no_key", "seen"), ["key", "no_key"]), "wanted")
    # the same join for giving and taking, so that texts are dealt by id once
    whole = own.join(wants, ["key", "no_key"])
    given = whole.where(F.xxhash64("text").bitwiseXOR(F.col("seen")) == 0)  # no plain equality, which would become a key of the join
    given = given.select(F.col("for_key").alias("key"), F.col("for_none").alias("no_key"), F.expr("left(text, need)").alias("start"), signatures(F.col("text")).alias("next_signatures"))
    given = given.groupBy("key", "no_key").agg(F.first("start").alias("start"), F.first("next_signatures").alias("next_signatures"))
    rows = own.join(given, ["key", "no_key"])
    new = F.concat(F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 3) AS int))"), F.expr("left(start, cast(floor(char_length(text) / 3) AS int))"))
    return rows.select(F.when(~F.col("no_key"), F.col("key")).alias("doc_id"), "text", new.alias("edited"), "next_signatures")


def fingerprint_edits(docs: DataFrame, text: str = "text") -> DataFrame:
    """Fingerprints of every row's text and edited text, and how alike they are to each other and to the next document's."""
    sets = edited(docs, text).select(
        "doc_id", F.char_length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        signatures(F.col("text")).alias("own"), signatures(F.col("edited")).alias("changed"), "next_signatures",
    )
    return sets.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next_signatures")).alias("near_next"),
    )
