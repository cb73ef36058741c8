"""Benchmark decontamination: every training passage queries a BM25 index of the test items.

The index holds the test items.  A term's weight in an item is its BM25 weight divided by the weight
of the whole item, so a passage's score is the share of the item it has.  Items lie in blocks; for
each term and block the index knows the largest weight, and a block whose largest weights cannot add
up to the threshold is skipped whole (block-max WAND).  Everything at or above the threshold is
retrieved, then verified: a passage must have shingles of the question and of the answer.  Shingles are
of five words; a part with fewer words is looked up as one shingle of its own length, so a passage is
also hashed at the lengths that its candidates need.

The index is built in a task and travels with the tasks that search it, only up to ``max_index_rows`` postings, as
arrays.  A larger set of items is cut into shards of about that many, and every passage queries every shard; document
frequencies always come from all items.

Defined cases: null or empty texts and items match nothing; items with equal texts are all reported;
null ids are kept; repeated rows are reported each; no items or no documents give results without
leaks; other columns are kept (``find_leaks`` replaces one called ``_leaks``, ``decontaminate`` none).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harvestlake.llm import kernels
from harvestlake.llm.common import stored
from harvestlake.session import ship_with_tasks

ship_with_tasks(__name__)

K1, B = 1.2, 0.75
BLOCK = 32
SHINGLE = 5
#: Share of an item's weight a passage must have; shares of question and answer shingles; or of the whole item.
RETRIEVE, PART, WHOLE = 0.5, 0.5, 0.8

_END = re.compile(r"[.!?\n](?=\s)|\n")


def question_and_answer(text: str) -> tuple[str, str]:
    """An item's answer is its last line or else its last sentence; all before is the question."""
    text = text.strip()
    cut = text.rfind("\n")
    if cut < 0:
        ends = [m.end() for m in re.finditer(r"[.!?](?=\s)", text)]
        cut = ends[-1] if ends else -1
    return (text[:cut].strip(), text[cut:].strip()) if cut > 0 else (text, "")


@dataclass
class Index:
    """Postings by term (sorted hashes) to items, and to blocks with their largest weight."""

    terms: np.ndarray
    item_start: np.ndarray
    item_of: np.ndarray
    weight: np.ndarray
    block_start: np.ndarray
    block_of: np.ndarray
    block_weight: np.ndarray
    ids: list
    shingles: list  # per item: width and shingles of the whole, of the question, of the answer
    longest: int

    @property
    def blocks(self) -> int:
        return -(-len(self.ids) // BLOCK)


def _gather(start: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Places of all postings of the terms."""
    sizes = start[terms + 1] - start[terms]
    total = int(sizes.sum())
    if not total:
        return np.empty(0, np.int64)
    first = np.repeat(start[terms] - (np.cumsum(sizes) - sizes), sizes)
    return first + np.arange(total)


def build_index(rows: list[tuple[object, str]], gains: dict[int, float], mean_length: float) -> Index:
    """Index of one shard of items; ``gains`` (the inverse document frequencies) and ``mean_length`` are of all items."""
    ids, shingles, posts, longest = [], [], [], 1
    for item, text in rows:
        words = kernels.word_hashes(text)
        if not len(words):
            continue
        terms, tf = np.unique(words, return_counts=True)
        gain = np.array([gains[t] for t in kernels.signed(terms).tolist()])
        w = gain * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean_length))
        posts.append((terms, np.full(len(terms), len(ids)), w / w.sum()))
        question, answer = question_and_answer(text)
        parts = [kernels.word_hashes(x) for x in (text, question, answer)]
        shingles.append([(min(SHINGLE, len(p)), kernels.shingles(p, SHINGLE)) for p in parts])
        ids.append(item)
        longest = max(longest, len(words))
    if not posts:
        none = np.empty(0, np.int64)
        return Index(none.view(np.uint64), np.zeros(1, np.int64), none, none.astype(float), np.zeros(1, np.int64), none, none.astype(float), [], [], 1)
    term, item, weight = (np.concatenate(x) for x in zip(*posts, strict=True))
    order = np.lexsort((item, term))
    term, item, weight = term[order], item[order], weight[order]
    terms, starts = np.unique(term, return_index=True)
    pair = np.searchsorted(terms, term) * (len(ids) // BLOCK + 1) + item // BLOCK
    at = np.flatnonzero(np.diff(pair, prepend=-1))
    block_weight = np.maximum.reduceat(weight, at)
    return Index(
        terms, np.append(starts, len(term)), item, weight,
        np.append(np.searchsorted(at, starts), len(at)), item[at] // BLOCK, block_weight, ids, shingles, longest,
    )


def _open_blocks(index: Index, terms: np.ndarray) -> np.ndarray:
    """For every block, whether its largest weights for these terms reach the threshold."""
    at = _gather(index.block_start, terms)
    bound = np.bincount(index.block_of[at], index.block_weight[at], index.blocks)
    return bound >= RETRIEVE - 1e-9


def leaks(index: Index, text: str | None) -> list[tuple[object, float]]:
    """Items that a document holds, each with the best share of its weight found in a passage."""
    words = kernels.word_hashes(text)
    if not len(words) or not index.ids:
        return []
    place = np.searchsorted(index.terms, words)
    place[place == len(index.terms)] = 0
    known = index.terms[place] == words
    if not _open_blocks(index, np.unique(place[known])).any():
        return []
    half = max(64, index.longest)
    found: dict[int, float] = {}
    for begin in range(0, max(1, len(words) - half), half):
        end = begin + 2 * half
        terms = np.unique(place[begin:end][known[begin:end]])
        blocks = _open_blocks(index, terms)
        if not blocks.any():
            continue
        at = _gather(index.item_start, terms)
        if not blocks.all():
            at = at[blocks[index.item_of[at] // BLOCK]]
        share = np.bincount(index.item_of[at], index.weight[at], len(index.ids))
        hits = np.flatnonzero(share >= RETRIEVE - 1e-9)
        if not len(hits):
            continue
        passage: dict[int, np.ndarray] = {}
        for i in hits.tolist():
            if _verified(index.shingles[i], words[begin:end], passage):
                found[i] = max(found.get(i, 0.0), float(share[i]))
    return sorted(((index.ids[i], s) for i, s in found.items()), key=lambda x: (x[0] is None, x[0] or 0))


def _verified(parts: list[tuple[int, np.ndarray]], words: np.ndarray, passage: dict[int, np.ndarray]) -> bool:
    """Whether a passage has enough shingles of the question and of the answer, or of the whole item.

    ``passage`` keeps the shingles of its ``words`` by width.
    """

    def share(width: int, part: np.ndarray) -> float:
        if not len(part):
            return 1.0
        if width not in passage:
            passage[width] = kernels.shingles(words, width)
        return float(np.isin(part, passage[width]).mean())

    whole, question, answer = (share(*p) for p in parts)
    return whole >= WHOLE or (whole > 0 and question >= PART and answer >= PART)


_LEAK = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("share", T.DoubleType())]))


def _index_shards(items: DataFrame, max_index_rows: int) -> list[bytes]:
    """Indexes over bounded shards of the items, each built in a task from its items and their terms' weights."""
    shard_of = F.xxhash64("item_id", "text")
    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("length(text) > 0").select("item_id", "text", shard_of.alias("place"))

    def postings(batches):
        for b in batches:
            words = [kernels.word_hashes(t) for t in b["text"]]
            terms = [kernels.signed(np.unique(w)) if len(w) else np.empty(0, np.int64) for w in words]
            sizes = [len(t) for t in terms]
            if terms:
                yield pd.DataFrame({"place": np.repeat(b["place"].to_numpy(), sizes), "term": np.concatenate(terms), "words": np.repeat([len(w) for w in words], sizes), "first": np.concatenate([np.arange(k) == 0 for k in sizes])})

    post = rows.mapInPandas(postings, "place bigint, term bigint, words bigint, first boolean")
    total = post.agg(F.count("*").alias("n"), F.sum(F.col("first").cast("int")).alias("items"), F.sum(F.when(F.col("first"), F.col("words"))).alias("words")).first()
    if not total["items"]:
        return []
    n, mean = total["items"], total["words"] / total["items"]
    shard = F.pmod("place", F.lit(max(1, -(-total["n"] // max_index_rows)))).cast("int").alias("shard")
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    gains = post.select(shard, "term").distinct().join(df, "term").select("shard", F.lit(None).cast("bigint").alias("item_id"), F.lit(None).cast("string").alias("text"), "term", "df")
    texts = rows.select(shard, "item_id", "text", F.lit(None).cast("bigint").alias("term"), F.lit(None).cast("bigint").alias("df"))

    def build(part: pa.Table) -> pa.Table:
        is_term = pc.is_valid(part["term"])
        terms = part.filter(is_term)
        own = part.filter(pc.invert(is_term))
        seen = terms["df"].to_numpy()
        known = dict(zip(terms["term"].to_pylist(), np.log(1 + (n - seen + 0.5) / (seen + 0.5)).tolist(), strict=True))
        got = sorted(zip(own["item_id"].to_pylist(), own["text"].to_pylist(), strict=True), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        return pa.table({"index": pa.array([cloudpickle.dumps(build_index(got, known, mean))], pa.binary())})

    built = stored(texts.unionByName(gains).groupBy("shard").applyInArrow(build, "index binary"), "indexes")
    return [bytes(r["index"]) for r in built.collect()]


def _searcher(packed: bytes):
    @F.pandas_udf(_LEAK)
    def search(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = cloudpickle.loads(packed)
        for texts in parts:
            yield pd.Series([[{"item_id": i, "share": s} for i, s in leaks(index, t)] for t in texts], dtype=object)

    return search


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text", max_index_rows: int = 2_000_000) -> DataFrame:
    """All columns of ``docs`` and ``_leaks``, the items that each document holds."""
    out = docs.withColumn("_leaks", F.array().cast(_LEAK))
    for index in _index_shards(items, max_index_rows):
        out = out.withColumn("_leaks", F.concat("_leaks", _searcher(index)(F.col(text))))
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents that hold no test item, with all their columns."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    return find_leaks(rows, items).where(F.size("_leaks") == 0).select("row.*")
