"""Quotation linking: messages are joined to the messages they quote, then put in reply order without quotes.

A line that starts with ``>`` marks is quoted, one level per mark.  Neighbouring lines of one level
are a passage.  Passages and the own lines of every message are normalised (letter case, white
space) and hashed; a passage is linked, within its conversation, to the latest earlier message whose
whole own text, or else whose single line, has the hash.  A message replies to the message that its
outermost linked passages quote last, else to the turn before it.  Replies come after what they
answer, so the order of turns, numbered without gaps, is the reply order.

Everything is DataFrame functions.  Latest-earlier-message and numbering are running values cut into
chunks of turns, so a conversation of any length spreads over tasks.

Defined cases: a null or empty text is a message without lines; a message that only quotes has empty
text; messages of a null conversation form one conversation, null turns come first; repeated rows
are one message each, numbered one after the other; passages that nothing earlier has stay unlinked;
an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from harvestlake.llm.common import stored

#: Turns per chunk of a running value.
CHUNK = 4096
_MARKS = r"^((?:\s?>)+)\s?"


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def _running_max(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Largest ``value`` among strictly earlier turns of a key, carried over chunks of turns."""
    chunk = F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / CHUNK)
    rows = df.withColumn("_chunk", chunk)
    inside = W.partitionBy(*keys, "_chunk").orderBy("turn").rangeBetween(W.unboundedPreceding, W.currentRow)
    per_chunk = rows.groupBy(*keys, "_chunk").agg(F.max(value).alias("_top"))
    earlier = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = per_chunk.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_chunk").alias("_k_chunk"), F.max("_top").over(earlier).alias("_carry"))
    local = rows.withColumn("_local", F.max(value).over(inside))
    same = F.col("_chunk") == F.col("_k_chunk")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return local.join(carried, same).select(*df.columns, F.greatest("_local", "_carry").alias(name))


def quoted_lines(messages: DataFrame) -> DataFrame:
    """One row per line: conversation, turn, ``line`` number, quote ``level`` and bare ``words``."""
    lines = messages.select("conv_id", "turn", "_row", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "raw"))
    marks = F.regexp_extract("raw", _MARKS, 1)
    return lines.select(
        "conv_id", "turn", "_row", "line", "raw",
        F.length(F.translate(marks, " \t", "")).alias("level"),
        F.regexp_replace("raw", _MARKS, "").alias("words"),
    )


def _passages(lines: DataFrame) -> DataFrame:
    """Maximal runs of quoted lines of one level: normalised text, hash and the hashes of their lines."""
    w = W.partitionBy("conv_id", "turn", "_row").orderBy("line")
    runs = lines.withColumn("_new", (F.coalesce(F.lag("level").over(w), F.lit(-1)) != F.col("level")).cast("int"))
    runs = runs.withColumn("passage", F.sum("_new").over(w)).where("level > 0")
    return runs.groupBy("conv_id", "turn", "_row", "passage").agg(
        F.max("level").alias("level"),
        F.transform(F.array_sort(F.collect_list(F.struct("line", "words"))), lambda x: normalised(x["words"])).alias("parts"),
    )


def _hash(text: Column) -> Column:
    return F.when(text != "", F.xxhash64(text))


def link_quotations(messages: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``position``, ``role``, ``reply_to``, ``n_quoted``, ``n_linked`` and unquoted ``text`` of every message.

    ``reply_to`` is the turn that the message answers, null for the first.
    """
    base = messages.select("conv_id", "turn", "role", "text")
    base = base.withColumn("_row", F.xxhash64(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))))
    # repeated rows are linked once and come back through their count
    once = base.groupBy("conv_id", "turn", "_row").agg(F.first("role").alias("role"), F.first("text").alias("text"), F.count("*").alias("_copies"))
    split = F.split(F.coalesce("text", F.lit("")), "\n")
    own = F.filter(split, lambda x: ~x.rlike(_MARKS))
    bare = once.select("conv_id", "turn", "_row", "role", "_copies", "text", F.trim(F.array_join(own, "\n")).alias("own"))

    bare = stored(bare, "messages")

    passages = _passages(quoted_lines(bare.where(F.col("text").rlike(r"(?m)^\s?>"))))
    whole = F.concat_ws(" ", F.filter("parts", lambda x: x != ""))
    asked = passages.select(
        "conv_id", "turn", "_row", "passage", "level",
        F.explode(F.array_distinct(F.concat(F.array(_hash(whole)), F.transform("parts", _hash)))).alias("h"),
        _hash(whole).alias("_whole"),
    ).where("h IS NOT NULL")
    asked = stored(asked, "passages")
    own_lines = F.filter(F.transform(F.split("own", "\n"), normalised), lambda x: x != "")
    keys = F.array_distinct(F.concat(F.array(_hash(F.array_join(own_lines, " "))), F.transform(own_lines, _hash)))
    told = bare.select("conv_id", "turn", F.explode(keys).alias("h")).where("h IS NOT NULL")
    wanted = asked.select(F.col("conv_id").alias("_conv"), F.col("h").alias("_h")).distinct()
    told = told.join(wanted, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("h") == F.col("_h")), "left_semi").distinct()

    # latest earlier teller of each asked hash: both sides in one table, a running maximum over turns
    events = told.select("conv_id", "turn", "h", F.col("turn").alias("said"), F.lit(None).cast("bigint").alias("_row"), F.lit(None).cast("bigint").alias("passage"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("bigint").alias("_whole"))
    asks = asked.select("conv_id", F.expr("turn - 1").alias("turn"), "h", F.lit(None).cast("bigint").alias("said"), "_row", F.col("passage").cast("bigint"), F.col("level").cast("int"), "_whole")
    found = _running_max(events.unionByName(asks), ["conv_id", "h"], "said", "source").where("passage IS NOT NULL")
    found = found.withColumn("turn", F.expr("turn + 1"))
    by_passage = found.groupBy("conv_id", "turn", "_row", "passage", "level").agg(
        F.max(F.when(F.col("h") == F.col("_whole"), F.col("source"))).alias("as_whole"), F.max("source").alias("as_line")
    )
    links = by_passage.withColumn("source", F.coalesce("as_whole", "as_line"))
    replies = links.groupBy(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("_row").alias("_r")).agg(
        F.count("*").alias("n_quoted"),
        F.count("source").alias("n_linked"),
        F.max(F.when(F.col("source").isNotNull(), F.struct((-F.col("level")).alias("near"), "source")))["source"].alias("answers"),
    )
    on = F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("turn").eqNullSafe(F.col("_t")) & (F.col("_row") == F.col("_r"))
    joined = bare.join(replies, on, "left").select(
        "conv_id", "turn", "_row", "role", "_copies", "own",
        F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "answers",
    )
    return _numbered(joined)


def _numbered(rows: DataFrame) -> DataFrame:
    """Number messages through chunks of turns, and fall back to the turn before where nothing is quoted."""
    rows = rows.withColumn("_chunk", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / CHUNK))
    inside = W.partitionBy("conv_id", "_chunk").orderBy("turn", "_row")
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    turns_before = W.partitionBy("conv_id", "_chunk").orderBy("turn").rangeBetween(W.unboundedPreceding, -1)
    local = rows.select("*", F.sum("_copies").over(upto).alias("_upto"), F.max("turn").over(turns_before).alias("_prev"))
    per_chunk = rows.groupBy("conv_id", "_chunk").agg(F.sum("_copies").alias("_n"), F.max("turn").alias("_last"))
    earlier = W.partitionBy("conv_id").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = per_chunk.select(
        F.col("conv_id").alias("_conv"), F.col("_chunk").alias("_kc"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"), F.max("_last").over(earlier).alias("_before")
    )
    both = local.join(carried, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_chunk") == F.col("_kc")))
    numbered = both.select(
        "conv_id", "turn", "role", "n_quoted", "n_linked",
        F.coalesce("answers", "_prev", "_before").cast("bigint").alias("reply_to"),
        F.explode(F.sequence(F.col("_base") + F.col("_upto") - F.col("_copies"), F.col("_base") + F.col("_upto") - 1)).alias("position"),
        F.col("own").alias("text"),
    )
    return numbered.select("conv_id", "turn", "position", "role", "reply_to", "n_quoted", "n_linked", "text")


def as_mail(conversations: DataFrame) -> DataFrame:
    """Conversations as mail: every message after the first carries the one before as a quote, with that one's quote nested.

    All rows are kept.  Of several messages of one turn, the least by role and text is the one that later turns quote;
    nothing comes a turn before or after a null turn.
    """
    one = conversations.groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("m")).select("conv_id", "turn", F.col("m.text").alias("text"))

    def quoted(text: str, mark: str) -> Column:
        return F.array_join(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.concat(F.lit(mark), x)), "\n")

    def before(turns: int, name: str) -> DataFrame:
        return one.where("turn IS NOT NULL").select(F.col("conv_id").alias(f"_conv{name}"), (F.col("turn") + turns).alias(f"_turn{name}"), F.col("text").alias(name))

    def at(name: str) -> Column:
        return F.col("conv_id").eqNullSafe(F.col(f"_conv{name}")) & (F.col("turn") == F.col(f"_turn{name}"))

    rows = conversations.select("conv_id", "turn", "role", "text")
    joined = rows.join(before(1, "_one"), at("_one"), "left").join(before(2, "_two"), at("_two"), "left")
    parts = F.array(
        F.when(F.col("_two").isNotNull(), quoted("_two", ">> ")), F.when(F.col("_one").isNotNull(), quoted("_one", "> ")), F.coalesce("text", F.lit(""))
    )
    return joined.select("conv_id", "turn", "role", F.array_join(F.filter(parts, lambda x: x.isNotNull()), "\n").alias("text"))
