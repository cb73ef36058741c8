"""Exact Jaccard join of word-shingle sets by skipping over index lists, with answers derived from similar sets.

Every set is ordered by one order of shingles, rare ones first, and its first shingles are indexed:
two sets that link must share one of these.  A list with one set is dropped.

Each set is first compared with the first of its lists.  Sets that are near that one, even if they do not
link, form its group, and the exact difference to it is kept.  From then on the answers of a member are
derived from those of the set it resembles: the difference of two members is the difference of their
differences, so no two members are compared by their whole sets and no list is read for them.  The
differences are first taken again from what most members have in common, which makes them short.  Members whose
differences together are below the threshold link without a look at them; any other pair that links must
share an edit, so only members that share one of their rarest edits meet (``_derived``).

Pairs of different groups and components are looked for in the lists.  A list is cut into blocks of sets of like size
and blocks whose sizes cannot link are skipped; within a block, size and position of the shingle bound what two sets can
share and the parities of hash parts bound what tells them apart.  The group that has most of a list never meets itself, so a
list of near copies costs in proportion to its length and not the square.  For components, links inside a component
are not listed.  ``count_links`` verifies all pairs that lists leave and counts the links of every row.

Verification is exact, in two steps: the parities of hash parts of both sets show a lower bound of
their difference, and pairs that pass compare the whole sets, made anew from the texts.

The order uses estimated frequencies from a table of counters over all shingles of all texts.  Any
order gives the same links; a better one only gives shorter lists.

Defined cases: a null, empty or blank text has no shingles and links with nothing, its component is
its own id; repeated rows and equal sets share a component; null ids link like any row but name a
component only if it has no other id (then null); an empty table gives an empty result; other
columns are left out, or kept whatever their names (``keep_one``).
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from harvestlake.llm import kernels
from harvestlake.llm.common import components, discard, key_filter, may_join, stored
from harvestlake.session import ship_with_tasks

ship_with_tasks(__name__)

#: Counters that travel together.
BLOCK = 1 << 12
#: Words of 64 parities that a set carries through the lists.
PARITY = 2
#: Bits of a shingle's hash that name its list; shingles that share a name only share a list.
TOKEN = 48
#: Texts that a task turns into shingles at once.
SLICE = 1000


def required_overlap(a, b, percent: int):
    """Smallest intersection with which sets of these sizes reach the threshold."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(size: int, percent: int) -> int:
    return size + (percent * size) // -100 + 1


def set_id(shingles: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def signature(shingles: np.ndarray) -> bytes:
    """One bit per hash part, whether it holds an odd number of shingles; at least three parts for two shingles.

    Sets with k different bits differ in k shingles at least.
    """
    parts = 1 << max(6, (len(shingles) * 3 // 2).bit_length())
    odd = np.bincount((shingles & np.uint64(parts - 1)).astype(np.int64), minlength=parts) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def difference_bound(a: bytes, b: bytes) -> int:
    """Different bits of two signatures; the longer one's parts are put together until they are as many."""
    short, long = sorted((a, b), key=len)
    n, folded = len(short), int.from_bytes(long[: len(short)], "little")
    for at in range(n, len(long), n):
        folded ^= int.from_bytes(long[at : at + n], "little")
    return (folded ^ int.from_bytes(short, "little")).bit_count()


def parity(shingles: np.ndarray) -> np.ndarray:
    """Whether each of 64 * PARITY hash parts holds an odd number of shingles: sets with k different bits differ in k shingles at least."""
    parts = 64 * PARITY
    odd = np.bincount((shingles & np.uint64(parts - 1)).astype(np.int64), minlength=parts) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def pack_counts(counts: np.ndarray) -> bytes:
    """A block of counters in the narrowest type that holds them, compressed."""
    return zlib.compress(counts.astype(np.min_scalar_type(int(counts.max()))).tobytes(), 1)


def unpack_counts(raw: bytes) -> np.ndarray:
    raw = zlib.decompress(raw)
    return np.frombuffer(raw, f"u{len(raw) // BLOCK}").astype(np.int64)


def shingle_levels(docs: DataFrame, width: int, text: str = "text", bits: int = 21) -> bytes:
    """About log2 of how many texts a shingle stands in, by the first bits of its hash.

    Counters of all texts are added up per task, then block by block; 2^bits counters reach the driver.
    Shingles rarer than the mean of a counter look alike, so larger corpora want more bits.
    """

    def packed(blocks):
        blocks = [(k, pack_counts(v)) for k, v in blocks if v.any()]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in blocks], pa.int32()), pa.array([v for _, v in blocks], pa.binary())], names=["block", "counts"])

    def count(batches):
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                seen = [_raw_shingles(t, width) for t in batch.column(0).slice(at, SLICE).to_pylist()]
                total += np.bincount((np.concatenate(seen) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        yield packed(enumerate(total.reshape(-1, BLOCK)))

    def add(batches):
        total = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[k] = total.get(k, 0) + unpack_counts(raw)
        yield packed(total.items())

    schema = "block int, counts binary"
    sums = docs.select(text).mapInArrow(count, schema).repartition("block").mapInArrow(add, schema)
    levels = np.zeros(1 << bits, np.uint8)
    for r in sums.collect():
        levels[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.log2(unpack_counts(r["counts"]) + 1).astype(np.uint8)
    return levels.tobytes()


def _raw_shingles(text: str | None, width: int) -> np.ndarray:
    """Shingle hashes of a text, repeats included: enough to count."""
    words = kernels.word_hashes(text)
    if not len(words):
        return words
    return kernels.shingles(words, width) if len(words) < 4 * width else kernels.runs(words, width)


def index_sets(docs: DataFrame, levels: bytes, width: int, percent: int, text: str = "text") -> DataFrame:
    """Per row: id, text hash, set size, set id, signature, the indexed shingles in order and parities."""
    rank = np.frombuffer(levels, np.uint8).astype(np.uint64)
    shift = np.uint64(64 - (len(levels).bit_length() - 1))

    def index(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                sizes, ids, sigs, toks, odd = [], [], [], [], []
                for t in part.column(2).to_pylist():
                    s = kernels.shingles(kernels.word_hashes(t), width)
                    key = (rank[(s >> shift).astype(np.int64)] << np.uint64(58)) | (s >> np.uint64(6))
                    order = np.argsort(key, kind="stable")[: prefix_length(len(s), percent) if len(s) else 0]
                    sizes.append(len(s))
                    ids.append(set_id(s) if len(s) else 0)
                    sigs.append(signature(s) if len(s) else b"")
                    toks.append(kernels.signed(s[order] >> np.uint64(64 - TOKEN)))
                    odd.append(parity(s))
                ends = np.cumsum([0, *map(len, toks)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(toks)))
                cols = [part.column(0), part.column(1), pa.array(sizes, pa.int32()), pa.array(ids, pa.int64()), pa.array(sigs, pa.binary()), lists]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(v) for v in np.stack(odd, axis=1))], names=schema.names)

    rows = docs.select("doc_id", F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.col(text).alias("_text"))
    own = [T.StructField("n", T.IntegerType()), T.StructField("sid", T.LongType()), T.StructField("sig", T.BinaryType()), T.StructField("toks", T.ArrayType(T.LongType()))]
    schema = T.StructType([*rows.schema.fields[:2], *own, *[T.StructField(f"p{k}", T.LongType()) for k in range(PARITY)]])
    return rows.mapInArrow(index, schema)


def _lists(head: DataFrame) -> DataFrame:
    """Index lists that hold at least two sets: shingle, position, set and its size; the list's length and first set.

    A shingle seen once is dropped by a count of narrow keys.  All else is dealt by shingle once, and
    both the first sets and the lists are read from that one exchange.
    """
    posts = head.where("n > 0").select("sid", "n", F.posexplode("toks").alias("pos", "tok"))
    shared = posts.groupBy("tok").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("tok")
    lists = posts.join(shared.hint("merge"), "tok", "left_semi").distinct()
    least = F.min(F.struct("sid", "pos", "n"))
    first = lists.groupBy("tok").agg(least.alias("f"), F.max("sid").alias("hi"), F.count(F.lit(1)).alias("k")).where("f.sid <> hi")
    first = first.select("tok", F.col("f.sid").alias("a"), F.col("f.n").alias("n_a"), "k")
    return lists.join(first.hint("merge"), "tok")


def _near(pairs: DataFrame, head: DataFrame, docs: DataFrame, width: int, percent: int, text: str) -> DataFrame:
    """The pairs (``a``, ``b``) of set ids that reach the threshold, sizes, and the shingles that one of the two has alone."""
    sigs = head.where("n > 0").select("sid", "n", "sig")

    @F.pandas_udf(T.BooleanType())
    def near(n_a: pd.Series, a: pd.Series, n_b: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([
            min(x, y) * 100 >= percent * max(x, y) and difference_bound(s, t) <= x + y - 2 * required_overlap(x, y, percent)
            for x, s, y, t in zip(n_a.tolist(), a, n_b.tolist(), b, strict=True)
        ], dtype=bool)

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    few = stored(sigs.join(wanted, "sid", "left_semi").groupBy("sid").agg(F.first("n").alias("n"), F.first("sig").alias("sig")), "signatures")
    left = pairs.join(few.select(F.col("sid").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("s_a")), "a")
    both = left.join(few.select(F.col("sid").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("s_b")), "b")
    close = stored(both.where(near("n_a", "s_a", "n_b", "s_b")).select("a", "b"), "close")
    discard(few)

    # the whole sets of what is left, from one row of each
    needed = close.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    rows = head.where("n > 0").join(needed, "sid", "left_semi").groupBy("sid").agg(F.min("th").alias("th"))
    rows = stored(rows, "needed")
    hit = may_join(key_filter(rows, "th"))

    def whole(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                sets = [kernels.shingles(kernels.word_hashes(t), width) for t in batch.column(0).slice(at, SLICE).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["sid", "set"])

    hashed = docs.select(F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.col(text).alias("_text"))
    texts = hashed.where(hit("th")).join(rows.select("th"), "th", "left_semi")
    sets = stored(texts.dropDuplicates(["th"]).select("_text").mapInArrow(whole, "sid bigint, set binary"), "sets")

    def compare(batches):
        for batch in batches:
            out = []
            for a, b, x, y in zip(*(batch.column(i) for i in range(4)), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                apart = np.setxor1d(x, y, assume_unique=True)
                if len(x) + len(y) - len(apart) >= 2 * required_overlap(len(x), len(y), percent):
                    out.append((a.as_py(), b.as_py(), len(x), len(y), kernels.signed(apart)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["a", "b", "n_a", "n_b", "delta"])

    left = close.join(sets.select(F.col("sid").alias("a"), F.col("set").alias("x")), "a")
    both = left.join(sets.select(F.col("sid").alias("b"), F.col("set").alias("y")), "b")
    found = stored(both.select("a", "b", "x", "y").mapInArrow(compare, "a bigint, b bigint, n_a int, n_b int, delta array<bigint>"), "near")
    discard(close, rows, sets)
    return found


def looser(percent: int) -> int:
    """The threshold at which sets still share a group: about twice the difference that a link allows."""
    c = 2 * (100 - percent) / (100 + percent)
    return max(1, int(100 * (1 - c) / (1 + c)))


def _apart(x, y):
    """Elements of one of two arrays alone."""
    return F.concat(F.array_except(x, y), F.array_except(y, x))


def _grouped(near: DataFrame) -> DataFrame:
    """``grp``, ``sid``, ``n`` and ``delta`` (to the group's first set) of all members; the first set itself is one."""
    own = near.groupBy(F.col("b").alias("sid")).agg(F.min("a").alias("grp"), F.min_by(F.struct("n_a", F.col("n_b").alias("n"), "delta"), "a").alias("m"))
    own = stored(own.select("grp", "sid", "m.*"), "members")
    for _ in range(2):  # a first set that is a member itself takes its members along, unless they would differ more than they are large
        up = own.select(F.col("sid").alias("grp"), F.col("grp").alias("up"), F.col("n_a").alias("n_up"), F.col("delta").alias("to_up"))
        moved = own.join(up, "grp", "left").withColumn("moved", F.when(F.col("up").isNotNull(), _apart(F.col("delta"), F.col("to_up"))))
        go = F.coalesce(F.size("moved") <= F.col("n"), F.lit(False))
        before, own = own, stored(moved.select(*[F.when(go, F.col(new)).otherwise(F.col(c)).alias(c) for c, new in (("grp", "up"), ("n_a", "n_up"), ("delta", "moved"))], "sid", "n"), "members")
        discard(before)
    firsts = own.groupBy("grp").agg(F.first("n_a").alias("n")).select("grp", F.col("grp").alias("sid"), "n", F.array().cast("array<bigint>").alias("delta"))
    return own.select("grp", "sid", "n", "delta").unionByName(firsts)


def _stars(roots: DataFrame) -> DataFrame:
    """Links that stand for known components: each node with its root."""
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))


def _derived(members: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Components of ``links`` and of the links within groups, which come from the differences alone.

    With ``d`` the length of a difference and ``f = (100 + p) d - (100 - p) n``, two members link exactly if they share
    ``(f(x) + f(y)) / 2 (100 + p)`` edits.  The member with the least ``f`` links with all that need share none.  Of
    the others, each is tried with the least member that has one of its edits, and if that does not bring
    it to the component of the least, with every member that has it among its rarest edits.  Why that is enough: such a
    member shares more than ``(f(y) - f(least)) / 2 (100 + p)`` edits with any ``y`` it links with.
    """
    unit = 100 + percent
    edits = members.select("grp", F.explode("delta").alias("e")).groupBy("grp", "e").agg(F.count(F.lit(1)).alias("k"))
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    common = edits.join(sizes, "grp").where("2 * k > size").groupBy("grp").agg(F.collect_list("e").alias("common"))
    nothing = F.array().cast("array<bigint>")
    rows = members.join(common, "grp", "left").withColumn("delta", _apart(F.col("delta"), F.coalesce("common", nothing)))
    rows = stored(rows.select("grp", "sid", "delta", (unit * F.size("delta").cast("bigint") - (100 - percent) * F.col("n")).alias("f")), "differences")
    least = stored(rows.groupBy("grp").agg(F.min(F.struct("f", "sid")).alias("l")).select("grp", F.col("l.f").alias("f0"), F.col("l.sid").alias("s0")), "least")
    placed = rows.join(least, "grp")
    sure = placed.where("f + f0 <= 0 AND sid <> s0").select(F.col("s0").alias("a"), F.col("sid").alias("b"))
    open_ = placed.where("f + f0 > 0")

    def linked(pairs: DataFrame) -> DataFrame:
        x, y = (rows.select("grp", F.col("sid").alias(s), F.col("delta").alias(f"d_{s}"), F.col("f").alias(f"f_{s}")) for s in ("a", "b"))
        shared = F.size(F.array_intersect("d_a", "d_b"))
        return pairs.distinct().join(x, ["grp", "a"]).join(y, ["grp", "b"]).where(2 * unit * shared >= F.col("f_a") + F.col("f_b")).select("a", "b")

    # edits of groups with open members
    unsure = open_.select("grp").distinct()
    each = rows.join(unsure, "grp", "left_semi").join(least, "grp").select("grp", "sid", "f", "f0", F.size("delta").alias("d"), F.explode("delta").alias("e"))
    each = each.withColumn("k", F.count(F.lit(1)).over(W.partitionBy("grp", "e"))).where("k > 1")
    each = each.withColumn("first", F.min(F.struct("f", "sid")).over(W.partitionBy("grp", "e")))
    each = stored(each, "edits")
    tried = each.where("f + f0 > 0").select("grp", F.col("sid").alias("a"), F.col("first.sid").alias("b")).where("a <> b")
    roots = stored(components(links.unionByName(sure).unionByName(linked(tried))), "roots")

    # edits that one member has alone are the rarest: they are not in ``each``, but they count as places
    place = F.row_number().over(W.partitionBy("grp", "sid").orderBy("k", "e")) - 1
    alone = F.col("d") - F.count(F.lit(1)).over(W.partitionBy("grp", "sid"))
    at = each.select("grp", "sid", "f", "f0", "d", "e", (place + alone).alias("at"))
    where_ = at.join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    top = least.join(roots.select(F.col("node").alias("s0"), F.col("root").alias("r0")), "s0", "left").select("grp", F.coalesce("r0", "s0").alias("r0"))
    where_ = stored(where_.join(top, "grp"), "places")
    left = where_.where("f + f0 > 0 AND root <> r0").select("grp", "e", *[F.col(c).alias(f"{c}_a") for c in ("sid", "f", "d", "at", "root")])
    right = where_.where(F.col("at") < F.col("d") - F.floor((F.col("f") - F.col("f0")) / (2 * unit))).select("grp", "e", *[F.col(c).alias(f"{c}_b") for c in ("sid", "f", "d", "at", "root")])
    needed = (F.col("f_a") + F.col("f_b")) / (2 * unit)
    meet = left.join(right, ["grp", "e"]).where((F.col("root_a") != F.col("root_b")) & (F.least(F.col("d_a") - F.col("at_a"), F.col("d_b") - F.col("at_b")) >= needed))
    more = linked(meet.select("grp", F.col("sid_a").alias("a"), F.col("sid_b").alias("b")))
    found = stored(components(_stars(roots).unionByName(more)), "roots")
    discard(rows, least, each, roots, where_)
    return found


def _most(n: str, pos: str, percent: int):
    """Largest size of a partner: a shingle at place ``pos`` leaves at most ``n - pos`` shared ones."""
    left = F.floor((F.col(n) - F.col(pos)) * (100 + percent) / percent) - F.col(n)
    return F.least(F.floor(F.col(n) * 100 / percent), left).cast("int")


def _answers(lists: DataFrame, percent: int) -> DataFrame:
    """Every list's first set with each set of the list that its size allows."""
    fits = (100 * F.least("n", "n_a") >= percent * F.greatest("n", "n_a")) & (F.col("sid") != F.col("a"))
    return lists.where(fits).select("a", F.col("sid").alias("b")).distinct()


def _cross_pairs(lists: DataFrame, groups: DataFrame, head: DataFrame, percent: int) -> DataFrame:
    """Pairs that lists leave between sets of different ``root`` and ``grp``; ``groups`` has both by ``sid``, for sets that have any.

    An entry's size and position say which sizes its partners can have, its parities how many
    shingles tell it from a partner at least.  Entries meet in blocks of like size, and the group that has most
    of a list only meets the others.
    """
    placed = lists.select("tok", "pos", "sid", "n").join(groups, "sid", "left").withColumn("root", F.coalesce("root", "sid")).withColumn("grp", F.coalesce("grp", "sid"))
    mixed = placed.groupBy("tok").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("grp").alias("g"), F.max("grp").alias("h")).where("lo <> hi AND g <> h").select("tok")
    mixed = stored(mixed, "mixed-lists")
    placed = placed.join(mixed, "tok", "left_semi")
    main = placed.groupBy("tok", "grp").agg(F.count(F.lit(1)).alias("k")).groupBy("tok").agg(F.max(F.struct("k", "grp")).alias("m")).where("m.k > 1").select("tok", F.col("m.grp").alias("main"))
    words = [f"p{k}" for k in range(PARITY)]
    parities = head.where("n > 0").groupBy("sid").agg(*[F.first(w).alias(w) for w in words])
    block = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent) * (1 + 1e-9))).cast("int") if percent < 100 else F.col("n")
    rows = placed.withColumn("most", _most("n", "pos", percent)).join(main, "tok", "left").join(parities, "sid")
    rows = rows.select("*", block.alias("block"), F.coalesce(F.col("grp") == F.col("main"), F.lit(False)).alias("is_main"))
    rows = stored(rows, "mixed")
    cols = ("sid", "n", "root", "grp", "most", *words)
    fits = (F.col("n_y") <= F.col("most_x")) & (F.col("n_x") <= F.col("most_y"))
    apart = (F.col("root_x") != F.col("root_y")) & (F.col("grp_x") != F.col("grp_y"))
    differ = sum((F.bit_count(F.col(f"{w}_x").bitwiseXOR(F.col(f"{w}_y"))) for w in words), F.lit(0))
    both = F.col("n_x") + F.col("n_y")
    like = differ <= both - 2 * F.ceil(percent * both / (100 + percent))
    smaller = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("sid_x") < F.col("sid_y")))
    others, mains = rows.where("NOT is_main"), rows.where("is_main")
    meetings = [(others, others, shift, smaller) for shift in (0, 1)] + [(others.where("main IS NOT NULL"), mains, shift, F.lit(True)) for shift in (0, 1, -1)]
    pairs = None
    for left, right, shift, order in meetings if percent < 100 else [m for m in meetings if m[2] == 0]:
        x = left.select("tok", (F.col("block") + shift).alias("block"), *[F.col(c).alias(f"{c}_x") for c in cols])
        y = right.select("tok", "block", *[F.col(c).alias(f"{c}_y") for c in cols])
        met = x.join(y, ["tok", "block"]).where(order & apart & fits & like).select(F.least("sid_x", "sid_y").alias("a"), F.greatest("sid_x", "sid_y").alias("b"))
        pairs = met if pairs is None else pairs.unionByName(met)
    found = stored(pairs.distinct(), "cross")
    discard(rows, mixed)
    return found


def link_sets(docs: DataFrame, width: int = 3, percent: int = 90, text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``th`` (hash of the text), ``n_shingles`` and ``root``, equal for sets that links connect; null without shingles."""
    levels = shingle_levels(docs, width, text)
    head = stored(index_sets(docs, levels, width, percent, text), "sets-head")
    lists = stored(_lists(head), "lists")
    loose = looser(percent)
    stars = stored(_answers(lists, loose), "stars")
    near = _near(stars, head, docs, width, loose, text)
    discard(stars)
    allowed = (100 + percent) * F.size("delta").cast("bigint") <= (100 - percent) * (F.col("n_a") + F.col("n_b")).cast("bigint")
    links = stored(near.where(allowed).select("a", "b"), "links-1")
    members = stored(_grouped(near), "groups")
    discard(near)
    roots = _derived(members, links, percent)
    of = members.groupBy("sid").agg(F.min("grp").alias("grp"))
    groups = stored(of.join(roots.withColumnRenamed("node", "sid"), "sid", "full"), "placed")
    # all pairs with the first of a list are decided, so most lists, those of two, are done with
    cross = _cross_pairs(lists.where("k > 2 AND sid <> a"), groups, head, percent)
    discard(lists, members, groups)
    found = _near(cross, head, docs, width, percent, text)
    discard(cross)
    last = components(_stars(roots).unionByName(found.select("a", "b")))
    rows = head.select("doc_id", "th", F.col("n").cast("bigint").alias("n_shingles"), F.when(F.col("n") > 0, F.col("sid")).alias("sid"))
    placed = rows.join(last.select(F.col("node").alias("sid"), "root"), "sid", "left")
    return placed.select("doc_id", "th", "n_shingles", F.coalesce("root", "sid").alias("root"))


def count_links(docs: DataFrame, width: int = 3, percent: int = 90, text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``n_links``, the number of other rows that a row links with, of every row.

    Here pairs inside a component are compared too, so all links are verified; rows with one set count as links.
    """
    head = stored(index_sets(docs, shingle_levels(docs, width, text), width, percent, text), "sets-head")
    lists = stored(_lists(head), "lists")
    none = head.select("sid", F.col("sid").alias("grp"), F.col("sid").alias("root")).limit(0)
    pairs = _cross_pairs(lists, none, head, percent)
    links = _near(pairs, head, docs, width, percent, text).select("a", "b")
    sizes = stored(head.where("n > 0").groupBy("sid").agg(F.count(F.lit(1)).alias("k")), "set-sizes")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(sizes.select(F.col("sid").alias("b"), "k"), "b").groupBy("a").agg(F.sum("k").alias("near"))
    per_set = sizes.join(near, F.col("sid") == F.col("a"), "left").select("sid", (F.col("k") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    rows = head.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.when(F.col("n") > 0, F.col("sid")).alias("sid"))
    return rows.join(per_set, "sid", "left").select("doc_id", "n_shingles", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def join_components(docs: DataFrame, width: int = 3, percent: int = 90, text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id``, the smallest id that links reach, of every row."""
    rows = stored(link_sets(docs, width, percent, text), "linked")
    ids = rows.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("_least"))
    joined = rows.join(ids, "root", "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("_least")).alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """One row of each component, the one with the smallest id, with all its columns; rows without shingles stay."""
    rows = stored(link_sets(docs, width, percent, text), "linked")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")
    kept = rows.where("root IS NOT NULL").groupBy("root").agg(F.min(order).alias("k")).select("k.doc_id", "k.th", F.lit(True).alias("one"))
    plain = rows.where("root IS NULL").select("doc_id", "th", F.lit(False).alias("one")).distinct()
    # the row travels as one struct, so its columns may have any names
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("own"))
    chosen = whole.join(kept.unionByName(plain), F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("th")))
    copy = F.when(F.col("one"), F.lit(-1).cast("bigint")).otherwise(F.monotonically_increasing_id())
    return chosen.withColumn("copy", copy).dropDuplicates(["own_id", "own", "copy"]).select("row.*")
