"""Spot signatures, conversation repair and whitening against plain versions on small tables."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from harvestlake.llm import dawg, spotsigs, whitening

# 13: conversation repair

TALK = "conv_id bigint, turn bigint, role string, text string"


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out.setdefault(conv, []).extend([(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1))
    return out


def brute_repair(messages):
    """The facts of one conversation, its edits by a search over (message, state) in order of cost and audit."""
    digest = lambda t: hashlib.md5(t.encode()).digest()
    rows = sorted(messages, key=lambda m: (m[0] is not None, m[0] or 0, m[1].encode(), m[2][:64].encode(), digest(m[2])))
    seen, kinds = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\f\r")
        kinds.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[:1] for _, r, _ in rows]
    turns = [t for t, _, _ in rows if t is not None]
    facts = [max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")]]
    facts.append(sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)))
    legal = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}
    heap, done = [(0, "", 0, "", [])], set()
    while True:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return (*facts, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
        for k, to in legal[state].items():
            if k in names:
                heapq.heappush(heap, (cost + 5, audit + "I", i, to, [*lines, names[k] + ":"]))
        if i < len(rows):
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, lines))
            if kinds[i] in ("blank", "duplicate"):
                continue
            more = 5 * (kinds[i] == "truncated")
            if initials[i] in legal[state]:
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, legal[state][initials[i]], [*lines, f"{rows[i][1]}:{rows[i][2]}"]))
            for k, to in legal[state].items():
                if k in names:
                    heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, to, [*lines, f"{names[k]}:{rows[i][2]}"]))


def conversations(rng, n):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, ""]
    texts = ["Hello there.", "ok", "Why?", "", " \n", None, "No end", "Fine!  ", "a.b", "é" * 80 + ".", "é" * 80 + "!"]
    rows = []
    for c in range(n):
        conv = None if c == n - 1 else c * 7 - 20
        for t in range(rng.randrange(1, 9)):
            turn = None if rng.random() < 0.1 else t + (rng.random() < 0.1) * 5
            role = rng.choice(roles) if rng.random() < 0.3 else ("user", "assistant")[t % 2]
            rows += [(conv, turn, role, rng.choice(texts) if rng.random() < 0.5 else f"Text {c} {t}.")] * (1 + (rng.random() < 0.1) * 4)
    return rows


@pytest.mark.parametrize("size", [2048, 3])
def test_repairs_equal_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(dawg, "ROWS", size)
    rows = conversations(random.Random(size), 150)
    rows += [(9000, t, ("user", "assistant")[t % 3 % 2], f"Long {t % 50}" + "."[t % 7 :]) for t in range(400)]
    frame = spark.createDataFrame(rows, TALK).withColumn("symbol", F.lit("clash")).withColumn("c", F.lit(1))
    got = {r.conv_id: tuple(r)[1:] for r in dawg.repair(frame).collect()}
    after = damaged(rows)
    assert got.keys() == {r[0] for r in rows}
    for conv, row in got.items():
        assert row == brute_repair(after.get(conv, [])), conv


def test_repairs_of_edge_cases(spark):
    assert dawg.repair(spark.createDataFrame([], TALK)).count() == 0
    rows = [(1, 2**62, "user", "x" * 3_000_000 + "."), (1, -(2**62), "user", "Hi."), (1, 3, "assistant", "Yes.")]
    rows = [r for r in rows if zlib.crc32(f"{r[0]}:{r[1]}".encode()) % 20 > 4] + [(2, None, None, None)] * 3
    got = {r.conv_id: tuple(r)[1:] for r in dawg.repair(spark.createDataFrame(rows, TALK)).collect()}
    after = damaged(rows)
    assert got == {c: brute_repair(after.get(c, [])) for c in got}


def test_endings_are_made_once():
    table = dawg.ending(True)
    for symbol in "aus":
        table = dawg.node(symbol, table)
    assert table[0][0] == (0, "KKK") and table[2][0] == (4, "DDR") or table[2][0][0] <= 4
    assert dawg.node("u", dawg.ending(False))[0][2] == (0, "K")


# 11: whitening

VECTORS = "vec_id bigint, embedding array<float>, label int"


def whitened_by_hand(vectors, k):
    x = [[int(np.floor(256 * float(np.float32(c)))) for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    mean = np.array(sums) / n
    centred = np.array(fit) - mean
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    return n, deviation, (np.array(x) - mean) @ turn / np.sqrt(values), values / np.square(centred).sum() * n


def test_whitening_equals_dense_algebra(spark):
    rng = np.random.default_rng(3)
    data = (rng.normal(size=(700, 24)) * np.linspace(3, 0.2, 24)).astype(np.float32).tolist()
    data += data[:50] + [data[0]] * 200
    rows = [(None if i == 5 else i, v, 0) for i, v in enumerate(data)]
    bad = [(9001, None, 0), (9002, [None, *data[0][1:]], 0), (9003, [float("nan"), *data[0][1:]], 0), (9004, [float("inf"), *data[0][1:]], 0), (9005, data[0][:20], 0), (9006, [], 0)]
    frame = spark.createDataFrame(rows + bad, VECTORS).withColumn("x", F.lit("clash")).repartition(6)
    got = whitening.whiten(frame).collect()
    assert len(got) == 4 * len(rows)
    n, deviation, white, explained = whitened_by_hand(data, 4)
    by = {(r.vec_id, r.component): r for r in got}
    sign = {c: np.sign(by[0, c].whitened * white[0, c - 1]) for c in range(1, 5)}
    for i, _ in enumerate(data):
        for c in range(1, 5):
            r = by[None if i == 5 else i, c]
            assert (r.n, r.deviation, r.deviation_exact) == (n, deviation[i], str(deviation[i]))
            assert abs(r.whitened * sign[c] - white[i, c - 1]) < 1e-9 and abs(r.explained - explained[c - 1]) < 1e-12 and r.identity_error < 1e-10


def test_whitening_of_edge_cases(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [], 0), (2, None, 0)], VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0], 0)] * 9, VECTORS)).count() == 0
    two = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0, 0.0], 0), (2, [0.5, 3.0, 0.0], 0)], VECTORS)).collect()
    assert sorted((r.vec_id, r.component, abs(round(r.whitened, 12)), round(r.explained, 12), r.deviation) for r in two) == [(1, 1, 1.0, 1.0, 512**2), (2, 1, 1.0, 1.0, 512**2)]
    huge = whitening.whiten(spark.createDataFrame([(i, [float(2**50 * (i - 1)), 1.0 + i], 0) for i in range(3)], VECTORS)).collect()
    n, deviation, white, _ = whitened_by_hand([[float(2**50 * (i - 1)), 1.0 + i] for i in range(3)], 1)
    assert {(r.vec_id, r.deviation, r.deviation_exact) for r in huge} == {(i, v if v < 1 << 63 else None, str(v)) for i, v in enumerate(deviation)}
    tiny = whitening.whiten(spark.createDataFrame([(i, [-1e-9 * i, 1.0], 0) for i in range(3)], VECTORS)).collect()
    assert {r.n for r in tiny} == {2}


def test_components_of_close_eigenvalues():
    rng = np.random.default_rng(5)
    for values in ([1.0] * 8, [3, 3, 3, 2, 2, 1, *[0.5] * 30], [1 + 1e-5 * k for k in range(60)], [10.0**-k for k in range(20)]):
        q, _ = np.linalg.qr(rng.normal(size=(len(values), len(values))))
        matrix = q @ np.diag(values) @ q.T
        matrix = (matrix + matrix.T) / 2
        e, u, r = whitening.leading(lambda t, m=matrix: m @ t, len(values), 4)
        assert np.allclose(e, sorted(values)[::-1][:4], rtol=1e-13) and (r < 1e-12).all() and np.allclose(u.T @ u, np.eye(4), atol=1e-12)


def test_minres_solves_every_column():
    rng = np.random.default_rng(6)
    a = rng.normal(size=(12, 12))
    a = a + a.T
    b = np.column_stack([rng.normal(size=(12, 2)), np.zeros(12)])
    assert np.allclose(a @ whitening.minres(lambda t: a @ t, b, 40), b, atol=1e-6)


# 12: fingerprints

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def by_hand(text):
    """Chains of a text as tuples."""
    words = re.findall(r"[.!?;:|\n]|[^\W_]+", text.lower())
    common = {*spotsigs.ANCHORS, *spotsigs.BREAKS}
    at = [i for i, w in enumerate(words) if w not in common]
    chains = set()
    for j, i in enumerate(at):
        if j == 0 or at[j - 1] < i - 1:
            chains.add((words[i - 1] if i else "^", *[words[p] for p in at[j : j + spotsigs.CHAIN]]))
    return chains or ({(text,)} if text else set())


def test_fingerprints_equal_plain_chains(spark):
    rng = random.Random(12)
    prose = [" ".join(rng.choice(["the", "of", "and", "der", "que", "fox.", "dog", "wolf,", "cat", "Bär", "ñu", "x1"]) for _ in range(rng.randrange(80))) for _ in range(60)]
    texts = [None, "", " ", "!!!", "word", "the of", "a b", *prose, prose[0], "the " * 5000 + "end", "no anchors here " * 3, "x" * 20000]
    rows = [((i * 37 % 1009) * 10**15 - 10**17, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, "null id", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("key", F.lit("clash")).withColumn("start", F.lit(0))
    got = {r.doc_id: r for r in spotsigs.fingerprint_edits(docs).collect()}
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0]) + [rows[-1]]
    prints = {}
    for r, s in zip(order, order[1:] + order[:1], strict=True):
        t, u = r[1] or "", s[1] or ""
        k = len(t) // 3
        new = t[: len(t) - k] + u[:k]
        g = got[r[0]]
        assert (g.n_chars, g.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        a, b, c = by_hand(t), by_hand(new), by_hand(u)

        def alike(x, y):
            return len(x & y) / len(x | y) if x | y else 1.0

        assert abs(g.near_edited - alike(a, b)) < 1e-12 and abs(g.near_next - alike(a, c)) < 1e-12
        prints.setdefault(g.fingerprint, set()).add(frozenset(a))
        prints.setdefault(g.edited_fingerprint, set()).add(frozenset(b))
    assert all(len(v) == 1 for v in prints.values()) and len(prints) == len(set().union(*prints.values()))


def test_fingerprints_of_edge_cases(spark):
    assert spotsigs.fingerprint_edits(spark.createDataFrame([], DOCS)).count() == 0
    alone = spotsigs.fingerprint_edits(spark.createDataFrame([(5, "the cat sat", "en", "s", 0)], DOCS)).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0 and alone[0].edited_sha256 == hashlib.sha256(b"the cat the").hexdigest()
    nulls = spotsigs.fingerprint_edits(spark.createDataFrame([(None, "the cat", "en", "s", 0), (None, "the cat", "en", "s", 0)], DOCS)).collect()
    assert len(nulls) == 2 and nulls[0] == nulls[1]
    twice = spotsigs.fingerprint_edits(spark.createDataFrame([(1, "the cat", "en", "s", 0)] * 2 + [(1, "a dog", "en", "s", 0), (0, "x", "en", "s", 0)], DOCS)).collect()
    assert sorted(r.n_chars for r in twice) == [1, 5, 7, 7]


def test_next_ids_of_any_spread(spark):
    rng = random.Random(13)
    ids = sorted({rng.randrange(-(1 << 63), 1 << 63) >> rng.randrange(64) for _ in range(3000)}, reverse=True)
    got = {r.id: r.next_id for r in spotsigs.next_ids(spark.createDataFrame([(i,) for i in ids + ids[:5]], "id bigint")).collect()}
    assert got == dict(zip(ids, ids[1:] + ids[:1], strict=True))
