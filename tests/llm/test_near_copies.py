"""Groups of near copies: exact components, and pairs in proportion to the group."""

import random

import pytest
from pyspark.sql import functions as F

from harvestlake.llm import common, jaccard

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def family(rng, n, words=150, most=3, base=None):
    """Near copies of one text, each with 1 to ``most`` words changed."""
    base = base or [f"b{rng.random():.9f}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for p in rng.sample(range(words), rng.randrange(1, most + 1)):
            how = rng.random()
            w[p] = f"e{rng.random():.9f}" if how < 0.8 else "" if how < 0.9 else w[p] + f" x{rng.random():.6f}"
        out.append(" ".join(x for x in w if x))
    return base, out


def components(texts, width, percent):
    """Component ids by an inverted index over all shingles, every pair with a common shingle compared."""
    sets, where = [], {}
    for i, t in enumerate(texts):
        w = t.split()
        s = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
        sets.append(s)
        for g in s:
            where.setdefault(g, []).append(i)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j in {j for g in s for j in where[g] if j < i}:
            if find(i) != find(j):
                k = len(s & sets[j])
                if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS).repartition(8)


@pytest.mark.parametrize("width, percent, most", [(5, 80, 4), (3, 90, 3)])
def test_components_of_families_equal_brute_force(spark, width, percent, most):
    rng = random.Random(width * percent + most)
    base, texts = family(rng, 250, most=most)
    # a second family that shares part of the first's text, one without edits, and texts that only share a passage
    other = base[:110] + [f"o{rng.random():.9f}" for _ in range(40)]
    texts += family(rng, 150, most=most, base=other)[1] + [" ".join(base)] * 3
    texts += [" ".join(base[:60] + [f"q{rng.random():.9f}" for _ in range(60)]) for _ in range(60)]
    # a chain whose ends differ
    chain = [f"c{k}" for k in range(150)]
    for k in range(40):
        chain = list(chain)
        chain[rng.randrange(150)] = f"d{k}"
        texts.append(" ".join(chain))
    rng.shuffle(texts)
    got = {r.doc_id: r.component_id for r in jaccard.join_components(frame(spark, texts), width, percent).collect()}
    assert [got[i] for i in range(len(texts))] == components(texts, width, percent)


def test_pairs_grow_with_the_group(spark, monkeypatch):
    seen = []
    whole = jaccard._near

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return whole(pairs, *rest)

    monkeypatch.setattr(jaccard, "_near", counted)
    for n in (400, 1200):
        texts = family(random.Random(n), n)[1]
        got = jaccard.join_components(frame(spark, texts), 5, 80).count()
        assert got == n
    assert seen[2] <= 4 * seen[0] and seen[3] <= max(100, 4 * seen[1]), seen


def test_names_may_clash(spark):
    texts = family(random.Random(3), 20)[1] + ["", "alone here", "alone here"]
    docs = frame(spark, texts)
    for c in ("row", "own", "own_id", "copy", "one", "th", "_id", "_th", "root"):
        docs = docs.withColumn(c, F.lit(c))
    kept = jaccard.keep_one(docs)
    want = components(texts, 5, 80)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, c in enumerate(want) if c == i or not texts[i]]
    assert {r["th"] for r in kept.collect()} == {"th"}


@pytest.mark.parametrize(("links", "rounds"), [([(i, 1) for i in range(2, 40)], 1), ([(9, 9)], 1), ([(i, i + 1) for i in range(1, 40)], None)])
def test_steps_of_components_are_planned_short(spark, monkeypatch, links, rounds):
    """The driver plans each step: no plan reads a table more than twice, and links that are stars take one round."""
    steps, write = [], common.stored

    def spy(df, label):
        steps.append((label, df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")))
        return write(df, label)

    monkeypatch.setattr(common, "stored", spy)
    got = {r.node: r.root for r in common.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 1 for a, b in links if a != b for i in (a, b)}
    assert max(reads for _, reads in steps) <= 2
    if rounds:
        assert [label for label, _ in steps].count("links") == 1 + rounds
