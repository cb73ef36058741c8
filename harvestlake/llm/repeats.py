"""Removal of byte strings that repeat anywhere in a corpus, by prefix-free parsing.

A rolling hash over ``gram`` bytes triggers phrase borders: every window of ``length`` bytes holds the
border where the hash is smallest, so equal windows lie at equal distances from equal borders.  The
borders of all texts are the parse; a border whose gram occurs once in the corpus can hold no repeat,
and its phrase is done with.  For the others corpus order is needed only to see which windows are
equal over ``length`` bytes, so instead of one suffix array over all places, ranks are compared from
coarse to fine: first the bytes that a range of window starts has in common (different: no
repeat), then all bytes that the range covers (equal: all repeat), and only where these disagree, at
the edges of a repeat, the single windows.

A place is a text's digest and an offset, so copies of a whole text are one text; texts that stand
in more than one row repeat wholly.  ``least and greatest place differ`` is how a group shows that
it repeats, which folds before any shuffle however large the group is.

Defined cases: a null text is empty; texts shorter than ``length`` bytes lose nothing; repeated rows
are copies of each other; null ids stay; an empty table gives an empty result; other columns are
left out of the report and kept by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harvestlake.llm import kernels
from harvestlake.llm.common import key_filter, may_join, payload, stored
from harvestlake.session import ship_with_tasks

ship_with_tasks(__name__)

LENGTH = 400
#: Window starts that are handled at once; bounds the memory of a very long text.
PART = 1 << 19


def _sizes(length: int) -> tuple[int, int]:
    """Bytes of a gram, and window starts per range."""
    return max(1, length // 4), max(1, length // 4)


def borders(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Borders of a text in order: place, first and last start of the windows it stands for, gram hash.

    A border may be given twice, with neighbouring ranges, where a part of the text ends.
    """
    gram, _ = _sizes(length)
    starts = len(data) - length + 1
    none = np.empty(0, np.int64)
    if starts < 1:
        return none, none, none, none.view(np.uint64)
    out = []
    for begin in range(0, starts, PART):
        stop = min(starts, begin + PART)
        hashes = kernels.Substrings(data[begin : stop + length - 1]).grams(gram)
        bits = np.uint64(21)
        keyed = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
        place = (kernels.sliding_min(keyed, length - gram + 1) & np.uint64((1 << 21) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(first[1:], len(place)) - 1
        out.append((place[first] + begin, first + begin, last + begin, hashes[place[first]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _hash_pair(data: np.ndarray):
    one, two = kernels.Substrings(data, 0), kernels.Substrings(data, 1)
    return lambda start, end: (one(start, end), two(start, end))


def ranges(data: np.ndarray, marks: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Ranges of window starts at the marked borders, cut at fixed distances from the border.

    Border, farthest and nearest distance of a start; hash of the bytes all windows of the whole range
    share; two hashes of all bytes the range covers.
    """
    _, step = _sizes(length)
    place, first, last, _ = borders(data, length)
    keep = np.isin(place, marks)
    place, far, near = place[keep], (place - first)[keep], (place - last)[keep]
    pieces = []
    for k in range(length // step + 1):
        lo, hi = np.maximum(near, k * step), np.minimum(far, k * step + step - 1)
        ok = lo <= hi
        if ok.any():
            pieces.append((place[ok], hi[ok], lo[ok], np.full(int(ok.sum()), k)))
    if not pieces:
        none = np.empty(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none.view(np.uint64)
    place, far, near, k = (np.concatenate(x) for x in zip(*pieces, strict=True))
    pair = _hash_pair(data)
    core = pair(place - k * step, place - (k * step + step - 1) + length)[0]
    one, two = pair(place - far, place - near + length)
    return place, far, near, kernels.mix(core + k.astype(np.uint64)), kernels.mix(one + (near * length + far).astype(np.uint64)), two


def _whole_words(data: np.ndarray, start: int, end: int) -> int:
    """Words of a text that lie wholly between two places."""
    space = kernels._space[data[max(0, start - 1) : end + 1]]
    if start == 0:
        space = np.concatenate(([True], space))
    if end == len(data):
        space = np.append(space, True)
    breaks = np.flatnonzero(space)
    return int((np.diff(breaks) > 1).sum())


def cut(data: np.ndarray, first: np.ndarray, last: np.ndarray, length: int, min_words: int = 0) -> tuple[int, int, bytes]:
    """Bytes and runs removed, and the bytes kept, when windows starting in the given ranges go.

    Runs of fewer than ``min_words`` whole words stay.
    """
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, first, 1)
    np.add.at(edge, last + length, -1)
    gone = np.cumsum(edge)[:-1] > 0
    if min_words:
        turns = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
        for a, b in zip(turns[::2], turns[1::2], strict=True):
            if _whole_words(data, a, b) < min_words:
                gone[a:b] = False
    return int(gone.sum()), int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=np.int8(0)) == 1)), data[~gone].tobytes()


def digest(text: str | Column) -> Column:
    """128 bits that stand for a whole text."""
    return F.unhex(F.substring(F.sha2(payload(text), 256), 1, 32))


def _shared(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that stand at two places at least."""
    return rows.groupBy(*keys).agg(F.min("occ").alias("_lo"), F.max("occ").alias("_hi")).where("_lo <> _hi").select(*keys)


def _column(values, kind):
    return pa.array(values, kind)


def _scan(texts: DataFrame, length: int) -> DataFrame:
    """The parse: ``h``, border and gram hash of every text."""

    def run(batches):
        for batch in batches:
            for h, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                place, _, _, gram = borders(np.frombuffer(raw.as_buffer(), np.uint8) if raw.as_py() else np.empty(0, np.uint8), length)
                if len(place):
                    place, at = np.unique(place, return_index=True)
                    yield pa.RecordBatch.from_arrays(
                        [_column([h] * len(place), pa.binary()), _column(place.astype(np.int32), pa.int32()), _column(kernels.signed(gram[at]), pa.int64())],
                        names=["h", "a", "g"],
                    )

    return texts.mapInArrow(run, "h binary, a int, g bigint")


def _fold(batches, work):
    """Run ``work`` over (h, raw bytes, extra column) rows and join its small batches."""
    for batch in batches:
        got = [work(h, np.frombuffer(raw, np.uint8), x) for h, raw, x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
        got = [g for g in got if g is not None]
        if got:
            yield pa.Table.from_batches(got).combine_chunks().to_batches()[0]


def _ranges_of(work: DataFrame, length: int) -> DataFrame:
    def one(h, data, marks):
        place, far, near, core, c1, c2 = ranges(data, np.asarray(marks, np.int64), length)
        if not len(place):
            return None
        return pa.RecordBatch.from_arrays(
            [
                _column([h] * len(place), pa.binary()), *[_column(x.astype(np.int32), pa.int32()) for x in (place, far, near)],
                *[_column(kernels.signed(x), pa.int64()) for x in (core, c1, c2)],
            ],
            names=["h", "a", "far", "near", "core", "c1", "c2"],
        )

    return work.mapInArrow(lambda b: _fold(b, one), "h binary, a int, far int, near int, core bigint, c1 bigint, c2 bigint")


def _windows_of(texts: DataFrame, length: int) -> DataFrame:
    """Hashes of the single windows of ranges: ``h``, start, two hashes, and whether the range is known to repeat."""

    def one(h, data, parts):
        start = np.concatenate([np.arange(p["a"] - p["far"], p["a"] - p["near"] + 1) for p in parts])
        whole = np.concatenate([np.full(p["far"] - p["near"] + 1, p["whole"]) for p in parts])
        w1, w2 = _hash_pair(data)(start, start + length)
        return pa.RecordBatch.from_arrays(
            [_column([h] * len(start), pa.binary()), _column(start.astype(np.int32), pa.int32()), _column(kernels.signed(w1), pa.int64()), _column(kernels.signed(w2), pa.int64()), _column(whole, pa.bool_())],
            names=["h", "i", "w1", "w2", "whole"],
        )

    return texts.mapInArrow(lambda b: _fold(b, one), "h binary, i int, w1 bigint, w2 bigint, whole boolean")


def repeated_ranges(docs: DataFrame, length: int = LENGTH, text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """What repeats, by text digest.

    First, ``h`` and ``raw`` of the texts with borders that others have; second, ``h``, ``lo`` and
    ``hi`` of ranges of window starts that repeat; third, ``h`` and ``copies`` of all texts.
    """
    base = docs.select("doc_id", digest(text).alias("h"), payload(text).alias("raw"))
    copies = base.groupBy("h").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"))
    occ = F.xxhash64("h", "a").alias("occ")

    parse = stored(_scan(base.where(F.octet_length("raw") >= length).select("h", "raw"), length), "parse")
    grams = _shared(parse.select("g", occ), "g")
    marked = parse.join(grams, "g", "left_semi").groupBy("h").agg(F.collect_set("a").alias("marks"))
    marked = stored(marked.join(copies.select("h", "rep"), "h").withColumn("hk", F.xxhash64("h")), "marked")
    hit = may_join(key_filter(marked, "hk"))
    near = base.where(F.octet_length("raw") >= length).withColumn("hk", F.xxhash64("h")).where(hit("hk")).select(F.col("h").alias("_h"), "doc_id", "raw")
    work = near.join(marked, (F.col("_h") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("rep"))).dropDuplicates(["h", "rep"]).select("h", "raw", "marks")
    work = stored(work, "work")

    found = stored(_ranges_of(work, length), "ranges").withColumn("occ", occ)
    cores = found.groupBy("core").agg(F.min("occ").alias("_lo"), F.max("occ").alias("_hi"), F.min("c1").alias("_c"), F.max("c1").alias("_d"))
    cores = cores.where("_lo <> _hi").select("core", (F.col("_c") != F.col("_d")).alias("mixed"))
    covers = found.groupBy("c1", "c2").agg(F.min("occ").alias("first"), F.max("occ").alias("_hi"))
    covers = covers.select("c1", "c2", "first", (F.col("first") != F.col("_hi")).alias("whole"))
    judged = stored(found.join(cores, "core").join(covers, ["c1", "c2"]).where("whole OR mixed"), "judged")
    wide = judged.where("whole").select("h", (F.col("a") - F.col("far")).alias("lo"), (F.col("a") - F.col("near")).alias("hi"))

    open_ranges = judged.where("mixed AND (NOT whole OR occ = first)")
    parts = open_ranges.groupBy("h").agg(F.collect_list(F.struct("a", "far", "near", "whole")).alias("parts"))
    windows = stored(_windows_of(work.select("h", "raw").join(parts, "h").select("h", "raw", "parts"), length), "windows").withColumn("occ", F.xxhash64("h", "i"))
    twice = windows.groupBy("w1", "w2").agg(F.min("occ").alias("_lo"), F.max("occ").alias("_hi"), F.max("whole").alias("_w")).where("_w OR _lo <> _hi")
    single = windows.where("NOT whole").join(twice.select("w1", "w2"), ["w1", "w2"], "left_semi")
    spans = wide.unionByName(single.select("h", F.col("i").alias("lo"), F.col("i").alias("hi")))
    return work.select("h", "raw"), spans, copies


def _cut_texts(work: DataFrame, spans: DataFrame, length: int, min_words: int = 0, decode: bool = False) -> DataFrame:
    """``h``, ``n_removed``, ``n_spans`` and the ``kept`` bytes of texts with repeated ranges.

    With ``decode``, what is kept is a text, without the characters that a run cuts in two.
    """
    lists = spans.groupBy("h").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    @F.pandas_udf(T.StructType([T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.StringType() if decode else T.BinaryType())]))
    def run(raw: pd.Series, ranges_: pd.Series) -> pd.DataFrame:
        rows = []
        for r, s in zip(raw, ranges_, strict=True):
            lo, hi = (np.array([x[k] for x in s], np.int64) for k in ("lo", "hi"))
            n_removed, n_spans, kept = cut(np.frombuffer(r, np.uint8), lo, hi, length, min_words)
            rows.append((n_removed, n_spans, kept.decode("utf-8", "ignore") if decode else kept))
        return pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept"])

    # called nondeterministic, or a condition on what is removed would run it a second time
    return work.join(lists, "h").select("h", run.asNondeterministic()("raw", "spans").alias("c")).select("h", "c.*")


def report_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256``."""
    work, spans, copies = repeated_ranges(docs, length, text)
    single = _cut_texts(work, spans, length).select("h", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    facts = stored(copies.select("h", "copies").join(single, "h", "left"), "facts")
    rows = docs.select("doc_id", digest(text).alias("h"), F.octet_length(payload(text)).cast("bigint").alias("n_bytes"), F.sha2(payload(text), 256).alias("_own"))
    all_gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    return rows.join(facts, "h").select(
        "doc_id", "n_bytes",
        F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(all_gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(all_gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "_own")).alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text", n_chars: str | None = None, min_words: int = 0) -> DataFrame:
    """The documents with the bytes left to them, all columns kept; documents with nothing left go.

    Where a removed run starts or ends inside a character, the rest of that character goes too.
    With ``min_words``, only runs of at least so many whole words go, so ``length`` may be short enough for
    passages that are counted in words.  ``n_chars`` names a column to set to the new number of characters.
    """
    work, spans, copies = repeated_ranges(docs, length, text)
    touched = _cut_texts(work, spans, length, min_words, decode=True).where("n_removed > 0").select("h", "kept", F.lit(False).alias("copy"))
    copied = copies.where("copies > 1").select("h", F.lit("").alias("kept"), F.lit(True).alias("copy"))
    changes = touched.unionByName(copied).groupBy("h").agg(F.max("copy").alias("copy"), F.max("kept").alias("kept"))
    changes = stored(changes.withColumn("hk", F.xxhash64("h")), "changes")
    hit = may_join(key_filter(changes, "hk"))
    # the row travels as one struct, so its columns may have any names
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), digest(text).alias("own")).withColumn("hit", hit(F.xxhash64("own")))
    joined = rows.where("hit").join(changes.select("h", "copy", "kept"), F.col("own") == F.col("h"), "left")
    old = F.col("row").getField(text)
    long = (F.octet_length(payload(old)) >= length) & (F.regexp_count(F.coalesce(old, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) >= min_words)
    cut_short = F.coalesce(~F.col("copy"), F.lit(False))
    changed = joined.where(~F.coalesce((F.col("copy") & long) | (cut_short & (F.col("kept") == "")), F.lit(False)))
    new = F.col("row").withField(text, F.col("kept"))
    if n_chars:
        new = new.withField(n_chars, F.length("kept").cast(docs.schema[n_chars].dataType))
    return rows.where("NOT hit").select("row.*").unionByName(changed.select(F.when(cut_short, new).otherwise(F.col("row")).alias("row")).select("row.*"))
