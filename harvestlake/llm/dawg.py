"""Repair of conversation structure over a suffix-shared automaton of role and fault signatures.

A message is a symbol: its role's initial and whether it must go (blank, duplicate) or is truncated.  A
conversation's symbols in turn order are its signature.  Signatures are sorted by their reversed text, so
those with a common ending lie next to each other; endings are shared and every distinct ending is one
node of the automaton, made once however many conversations have it.  A node holds, for each state
of the grammar ``(s?(ua)+)?``, the cheapest cost to go and the ASCII-least audit string of edits with that
cost.  Only the path of the current signature is in memory.

A conversation of any length spreads over tasks: rows are dealt by ranges of (conversation, turn) and cut into
chunks of at most ``ROWS`` messages or ``BYTES`` of text.  A chunk that is not the last of its conversation
has its nodes' tables for each state that it may end in; insertions come before a message, and at the very
end, so two audits of one chunk with different ends never continue one another and compare on
their own.  Chunks are then joined from the last to the first by costs and ranks alone.  Only the
hash of a repaired conversation reads it in order: one task streams its pieces.

Edits: Keep 0, Rerole to user or assistant 1, Delete 2, Insert an empty message 5; an undeleted truncated message
adds 5; blank and duplicate messages must be deleted.

Defined cases: null role and text are one space, a role whose initial is not s, u or a can be reroled or
deleted only (so can an empty one); null turns come first; messages of one turn are ordered by role, then the first 64
characters of the text, then a digest of it; identical messages of a turn are each one message, all but the first
duplicates; messages of a null conversation form one; a conversation with no message left has zeros, an
empty audit and the hash of the empty string; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestlake.llm.common import stored
from harvestlake.session import ship_with_tasks

ship_with_tasks(__name__)

ROWS, BYTES = 2048, 1 << 22
SPACES = " \t\n\x0b\f\r"
#: States of ``(s?(ua)+)?``: start, after s, after u, after a; and what each initial leads to.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
INSERTED = ("u", "u", "a", "u")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Symbol of a message that must be deleted; others are the initial (x: none of the grammar's), upper case if truncated.
GONE = "-"
EMPTY_HASH = hashlib.sha256(b"").hexdigest()

Best = tuple[int, str] | None


def _least(a: Best, b: Best) -> Best:
    return b if a is None or (b is not None and b < a) else a


def _plus(cost: int, edit: str, rest: Best) -> Best:
    return None if rest is None else (rest[0] + cost, edit + rest[1])


def ending(last: bool) -> list[list[Best]]:
    """Tables of the empty ending: of a last chunk one column (what is still to insert), else one for each end state."""
    if last:
        return [[(0, "")], [(2 * INSERT, "II")], [(INSERT, "I")], [(0, "")]]
    return [[(0, "") if s == e else None for e in range(4)] for s in range(4)]


def node(symbol: str, after: list[list[Best]]) -> list[list[Best]]:
    """Tables of an ending from its first symbol and the tables of what follows."""
    initial, extra = symbol.lower(), TRUNCATED * symbol.isupper()
    out = []
    for s in range(4):
        row = []
        for e in range(len(after[0])):
            best = _plus(DELETE, "D", after[s][e])
            if symbol != GONE:
                if initial in STEPS[s]:
                    best = _least(best, _plus(KEEP + extra, "K", after[STEPS[s][initial]][e]))
                best = _least(best, _plus(REROLE + extra, "R", after[STEPS[s][INSERTED[s]]][e]))
            row.append(best)
        out.append(row)
    for _ in range(3):  # no three insertions in a row are of use
        out = [[_least(out[s][e], _plus(INSERT, "I", out[STEPS[s][INSERTED[s]]][e])) for e in range(len(after[0]))] for s in range(4)]
    return out


def replay(symbols: str, roles: list[str], texts: list[str], state: int, audit: str) -> tuple[list[str], int]:
    """Lines ``role:text`` that an audit makes of a chunk, and the state it ends in."""
    lines, i, j = [], 0, 0
    for edit in audit:
        if edit == "I":
            lines.append("user:" if INSERTED[state] == "u" else "assistant:")
            state = STEPS[state][INSERTED[state]]
            continue
        symbol = symbols[i]
        i += 1
        if edit == "D":
            j += symbol != GONE
            continue
        if edit == "K":
            lines.append(f"{roles[j]}:{texts[j]}")
            state = STEPS[state][symbol.lower()]
        else:
            lines.append(("user:" if INSERTED[state] == "u" else "assistant:") + texts[j])
            state = STEPS[state][INSERTED[state]]
        j += 1
    return lines, state


def damage(rows: DataFrame) -> DataFrame:
    """The messages after damage, and ``copies`` of each, chosen by crc32 of ``conv_id:turn``; nulls are one space."""
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(c) for c in ("conv_id", ":", "turn")])
    named = rows.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], (F.crc32(key.cast("binary")) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return named.where("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies")
    )


def faults(messages: DataFrame) -> DataFrame:
    """Identical messages of a turn once, with ``copies``; ``symbol`` and ``blank``, ``again`` and ``cut`` of the first of them."""
    keys = ["conv_id", "turn", "role", "text"]
    once = messages.groupBy(*keys).agg(F.sum("copies").alias("copies")).withColumn("digest", F.unhex(F.md5("text")))
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = once.groupBy("conv_id", "role", "digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    rows = once.join(first, same, "left")
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    role = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    again = F.coalesce(order > F.col("first"), F.lit(False))
    cut = ~F.substring(bare, -1, 1).isin(".", "!", "?")
    return rows.select(
        "conv_id", "turn", "role", "text", "digest", "copies", (bare == "").alias("blank"), again.alias("again"), cut.alias("cut"),
        F.when((bare == "") | again, GONE).when(cut, F.upper(role)).otherwise(role).alias("symbol"),
    )


CHUNK = (
    "conv_id bigint, part int, idx int, symbols string, roles array<string>, texts array<string>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "head string, tail string, turns bigint, low bigint, high bigint, first_turn bigint, last_turn bigint"
)


def _illegal(a: str, b: str) -> bool:
    return a + b not in ("su", "ua", "au")


class _Chunk:
    """Messages gathered in order; one row of the chunk table."""

    def __init__(self, conv: int | None):
        self.conv, self.symbols, self.roles, self.texts, self.bytes = conv, [], [], [], 0
        self.n, self.blank, self.duplicate, self.truncated, self.illegal = 0, 0, 0, 0, 0
        self.turns, self.low = 0, None
        self.head = self.tail = self.first_turn = self.last_turn = None

    def add(self, turn, role, text, blank, again, cut, symbol, copies):
        """``copies`` messages of which the first has the symbol, the others must go."""
        initial = role[:1]
        if self.n:
            self.illegal += _illegal(self.tail, initial)
        else:
            self.head, self.first_turn = initial, turn
        self.illegal += (copies - 1) * _illegal(initial, initial)
        if turn is not None and turn != self.last_turn:  # turns are sorted, null first
            self.turns += 1
        if self.low is None:
            self.low = turn
        self.tail, self.last_turn = initial, turn
        self.symbols.append(symbol + GONE * (copies - 1))
        self.n += copies
        if blank:
            self.blank += copies
        else:
            self.duplicate += copies - 1 + again
            self.truncated += cut and not again
        if symbol != GONE:
            self.roles.append(role)
            self.texts.append(text)
            self.bytes += len(text)

    def row(self, part: int, idx: int) -> tuple:
        return (
            self.conv, part, idx, "".join(self.symbols), self.roles, self.texts, self.blank, self.duplicate, self.truncated, self.illegal, self.head, self.tail, self.turns, self.low, self.last_turn, self.first_turn, self.last_turn,
        )


def chunks(messages: DataFrame) -> DataFrame:
    """Chunks of conversations, dealt by ranges of conversation and turn."""
    schema = pa.schema([
        ("conv_id", pa.int64()), ("part", pa.int32()), ("idx", pa.int32()), ("symbols", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
        *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")], ("head", pa.string()), ("tail", pa.string()),
        *[(c, pa.int64()) for c in ("turns", "low", "high", "first_turn", "last_turn")],
    ])

    def cut(batches):
        part, idx, now, out, held = TaskContext.get().partitionId(), 0, None, [], 0

        def flush(rows):
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        for batch in batches:
            names = ("conv_id", "turn", "role", "text", "blank", "again", "cut", "symbol", "copies")
            for conv, turn, role, text, blank, again, cut_, symbol, copies in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True):
                while copies:
                    if now is not None and (now.conv != conv or now.n >= ROWS or now.bytes >= BYTES):
                        out.append(now.row(part, idx))
                        idx, held = idx + 1, held + now.bytes
                        now = None
                        if len(out) >= 1000 or held >= BYTES:
                            yield flush(out)
                            out, held = [], 0
                    if now is None:
                        now = _Chunk(conv)
                    some = min(copies, ROWS)
                    now.add(turn, role, text, blank, again, cut_, symbol, some)
                    copies -= some
                    again, symbol = True, GONE
        if now is not None:
            out.append(now.row(part, idx))
        if out:
            yield flush(out)

    keys = ["conv_id", "turn", "role", "beginning", "digest"]
    order = [F.col(k).asc_nulls_first() for k in keys]
    rows = messages.withColumn("beginning", F.substring("text", 1, 64)).repartitionByRange(*order).sortWithinPartitions(*order)
    return rows.mapInArrow(cut, CHUNK)


def solve(signatures: DataFrame) -> DataFrame:
    """``symbols`` and ``last`` with ``costs`` and ``audits`` by start state (and end state, unless last) of every distinct signature."""

    def run(batches):
        path, seen, kind = [], "", None
        for batch in batches:
            rows = []
            for symbols, last in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                back = symbols[::-1]
                if last != kind:
                    path, seen, kind = [ending(last)], "", last
                same = 0
                while same < min(len(seen), len(back)) and seen[same] == back[same]:
                    same += 1
                del path[same + 1 :]
                for symbol in back[same:]:
                    path.append(node(symbol, path[-1]))
                seen = back
                flat = [best for row in path[-1] for best in row]
                rows.append((symbols, last, [b and b[0] for b in flat], [b and b[1] for b in flat]))
            if rows:
                cols = zip(*rows, strict=True)
                kinds = (pa.string(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["symbols", "last", "costs", "audits"])

    order = ["last", F.reverse("symbols")]
    spread = signatures.select("symbols", "last").distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    return spread.mapInArrow(run, "symbols string, last boolean, costs array<bigint>, audits array<string>")


def _joined(parts: pd.Series) -> pd.DataFrame:
    """The chunks of a conversation joined from the last to the first, and the facts that chunk borders change."""
    rows = []
    for chunk_rows in parts:
        own = sorted(chunk_rows, key=lambda c: (c["part"], c["idx"]))
        total = [[None] * 4 for _ in own]  # (cost, rank, slot, end state) by start state
        for k in range(len(own) - 1, -1, -1):
            costs, ranks = own[k]["costs"], own[k]["ranks"]  # -1: no way
            for s in range(4):
                if len(costs) == 4:
                    total[k][s] = (costs[s], 0, s, None)
                    continue
                options = [(costs[4 * s + e] + total[k + 1][e][0], ranks[4 * s + e], 4 * s + e, e) for e in range(4) if costs[4 * s + e] >= 0]
                total[k][s] = min(options, default=None)
        state, steps = 0, []
        for k, c in enumerate(own):
            _, _, slot, end = total[k][state]
            steps.append({"part": c["part"], "idx": c["idx"], "state": state, "slot": slot})
            state = end
        pairs = list(zip(own, own[1:], strict=False))
        known = [c for c in own if c["turns"]]
        rows.append((
            total[0][0][0], sum(c["illegal"] for c in own) + sum(_illegal(a["tail"], b["head"]) for a, b in pairs),
            sum(c["turns"] for c in own) - sum(1 for a, b in pairs if a["last_turn"] is not None and a["last_turn"] == b["first_turn"]),
            known[0]["low"] if known else None, known[-1]["high"] if known else None, steps,
        ))
    return pd.DataFrame(rows, columns=["cost", "illegal", "turns", "low", "high", "steps"])


def _pieces(chosen: DataFrame) -> DataFrame:
    """Audit and repaired lines of chunks; of a whole conversation only the hash of its lines."""

    def run(batches):
        for batch in batches:
            get = {n: batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("symbols", "roles", "texts", "state", "audit", "n_chunks")}
            pieces, hashes = [], []
            for symbols, roles, texts, state, audit, n in zip(*get.values(), strict=True):
                lines, _ = replay(symbols, roles, texts, state, audit)
                raw = "\n".join(lines).encode("utf-8", "surrogatepass")
                pieces.append(raw if n > 1 and lines else None)
                hashes.append(hashlib.sha256(raw).hexdigest() if n == 1 else None)
            keep = [batch.column(batch.schema.get_field_index(n)) for n in ("conv_id", "part", "idx", "audit", "n_chunks")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(pieces, pa.binary()), pa.array(hashes, pa.string())], names=["conv_id", "part", "idx", "audit", "n_chunks", "piece", "sha"])

    return chosen.mapInArrow(run, "conv_id bigint, part int, idx int, audit string, n_chunks bigint, piece binary, sha string")


def _streamed(pieces: DataFrame) -> DataFrame:
    """``conv_id``, ``audit`` and ``sha`` of conversations of several chunks, whose pieces are hashed in order as they come."""

    def run(batches):
        conv, state, empty, audits, started = None, None, True, [], False

        def done():
            return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array(["".join(audits)], pa.string()), pa.array([state.hexdigest()], pa.string())], names=["conv_id", "audit", "sha"])

        for batch in batches:
            for c, audit, piece in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("conv_id", "audit", "piece")), strict=True):
                if not started or c != conv:
                    if started:
                        yield done()
                    conv, state, empty, audits, started = c, hashlib.sha256(), True, [], True
                audits.append(audit)
                if piece is not None:
                    state.update(piece if empty else b"\n" + piece)
                    empty = False
        if started:
            yield done()

    dealt = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "idx")
    return dealt.select("conv_id", "audit", "piece").mapInArrow(run, "conv_id bigint, audit string, sha string")


def _ranks(audits: Column) -> Column:
    """Place of each end state's audit among those of its start state."""
    return F.transform(audits, lambda a, i: F.size(F.filter(F.slice(audits, (F.floor(i / 4) * 4 + 1).cast("int"), 4), lambda b: b < a)))


def repair(rows: DataFrame) -> DataFrame:
    """Faults, edits and the repaired hash of every conversation, after the damage that ``damage`` does."""
    return repair_damaged(damage(rows), rows.select("conv_id"))


def repair_damaged(messages: DataFrame, ids: DataFrame) -> DataFrame:
    """The same for messages (with ``copies``) as they are; ``ids`` names the conversations to report."""
    table = stored(chunks(faults(messages)), "chunks")
    key = ["part", "idx"]
    sizes = table.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.max(F.struct(*key)).alias("end"))
    place = table.select("conv_id", *key, "symbols").alias("t").join(sizes.alias("s"), F.col("t.conv_id").eqNullSafe(F.col("s.conv_id")))
    place = stored(place.select("t.*", "n_chunks", (F.struct(*key) == F.col("end")).alias("last")), "places")
    answers = stored(solve(place), "answers")
    found = place.join(answers, ["symbols", "last"])

    whole = found.where("n_chunks = 1").select(*key, F.lit(0).alias("state"), F.col("audits")[0].alias("audit"), "n_chunks", F.col("costs")[0].alias("cost"))
    facts = ["illegal", "head", "tail", "turns", "low", "high", "first_turn", "last_turn"]
    several = found.where("n_chunks > 1").select(*key, "n_chunks", F.transform("costs", lambda c: F.coalesce(c, F.lit(-1))).alias("costs"), _ranks(F.col("audits")).alias("ranks"), "audits")
    several = stored(several, "several")
    joined = table.select("conv_id", *key, *facts).join(several.drop("audits"), key).groupBy("conv_id").agg(F.collect_list(F.struct(*key, "costs", "ranks", *facts)).alias("parts"))
    path = F.pandas_udf(_joined, "cost bigint, illegal bigint, turns bigint, low bigint, high bigint, steps array<struct<part:int,idx:int,state:int,slot:int>>")
    joined = stored(joined.select("conv_id", path("parts").alias("j")).select("conv_id", "j.*"), "joined")
    steps = joined.select(F.explode("steps").alias("s")).select("s.*")
    picked = several.join(steps, key).select(*key, "state", F.get("audits", F.col("slot")).alias("audit"), "n_chunks", F.lit(None).cast("bigint").alias("cost"))

    pieces = stored(_pieces(table.join(whole.unionByName(picked), key)), "pieces")
    long = _streamed(pieces.where("n_chunks > 1"))

    # one row of facts after another, folded by conversation
    parts = [
        ids.select("conv_id"),
        table.select("conv_id", "blank", "duplicate", "truncated"),
        table.join(whole.select(*key, "cost"), key).select("conv_id", "illegal", "turns", "low", "high", "cost"),
        joined.select("conv_id", "illegal", "turns", "low", "high", "cost"),
        pieces.where("n_chunks = 1").select("conv_id", "audit", "sha"),
        long.select("conv_id", "audit", "sha"),
    ]
    one = parts[0]
    for p in parts[1:]:
        one = one.unionByName(p, allowMissingColumns=True)
    zero = F.lit(0).cast("bigint")
    wide = "decimal(21,0)"
    gaps = (F.max("high").cast(wide) - F.min("low").cast(wide) + 1 - F.sum("turns").cast(wide)).try_cast("bigint")
    return one.groupBy("conv_id").agg(
        F.coalesce(gaps, zero).alias("gaps"), *[F.coalesce(F.sum(c), zero).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("sha"), F.lit(EMPTY_HASH)).alias("repaired_sha256"),
    )
