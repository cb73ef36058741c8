"""Mixing to target weights by soft membership.

A table of labelled rows teaches a naive Bayes classifier on the first letters of words; it gives
every document a posterior over the domains.  Then each document gets a nonnegative rate so that the
expected tokens of every domain, the sum of rate x tokens x posterior, meet their targets.  Rates start
at 1 and follow projected gradient steps of the least-squares misfit.  A step needs only the
domain totals and their curvature, one small aggregate; a document's rate is the replay of the steps so far, so
nothing is written between steps and rates never leave the executors.

The gradient is scaled by the curvature among documents with rates above 0, so a step that clips no rate meets all
targets at once; a step that would not lower the misfit is halved, and when none does, plain gradient steps, each
domain scaled by its mass, are tried.  When these do not lower it either, or by less than a billionth, it is at its
least: targets that no rates can meet (a domain without documents) are missed by as little as possible.  What is
missed is returned with every row, per domain, as a share of all tokens.

All of it is DataFrame functions.  The classifier sees at most about ``max_rows`` labelled rows,
chosen by a hash of their id, and keeps ``max_terms`` terms, so the model that is broadcast has a bound.

Defined cases: null and empty texts have 0 tokens and the prior as posterior; null ids are mixed as
any row; repeated rows get equal rates, each its own; labels that disagree count for the smallest
domain name; labels of rows that are not there count for nothing; without any labelled row the posterior is uniform; domains that no target names get
target 0; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestlake.llm.common import stored

#: White space between words; letters of a word that the classifier sees; digits of a posterior.
SPACES = "\t\n\x0b\x0c\r"
LETTERS = 5
DIGITS = 3


def words(text: Column) -> Column:
    """Words and empty strings of a text."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(" "))
    return F.split(out, " ")


def term(word: Column) -> Column:
    """The first letters of a word, null for none."""
    return F.when(word != "", F.substring(word, 1, LETTERS))


def label_domains(labels: DataFrame) -> DataFrame:
    """Domains of the label table: ``toxic``, else ``good`` or ``junk`` by quality."""
    domain = F.when(F.col("toxic") == 1, F.lit("toxic")).when(F.col("quality") == 1, F.lit("good")).when(F.col("quality") == 0, F.lit("junk"))
    return labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(domain).alias("domain")).where("domain IS NOT NULL")


def fit(
    docs: DataFrame, domain_labels: DataFrame, domains: list[str], max_rows: int = 20_000, max_terms: int = 4_096, min_rows: int = 8, min_weight: float = 1.5
) -> tuple[DataFrame, dict[str, float]]:
    """The model, ``term`` and one log weight per domain, and the log priors.

    Only terms that tell a domain apart clearly are kept; small weights of common words are mostly noise.
    """
    known = domain_labels.where(F.col("domain").isin(domains))
    share = min(1.0, max_rows / max(1, known.count()))
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    priors = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    n_rows = sum(priors.values())
    log_prior = {d: _log((priors.get(d, 0) + 1) / (n_rows + len(domains))) for d in domains}
    # how many different words of the rows of each domain are a term
    seen = rows.select("domain", F.explode(F.array_distinct(words(F.col("text")))).alias("_word"))
    seen = seen.select("domain", term(F.col("_word")).alias("term")).where("term IS NOT NULL")
    counts = seen.groupBy("term").agg(*[F.sum((F.col("domain") == d).cast("bigint")).alias(f"n_{i}") for i, d in enumerate(domains)])
    total = sum(F.col(f"n_{i}") for i in range(len(domains)))
    rate = [(F.col(f"n_{i}") + 0.5) / (priors.get(d, 0) + 1.0) for i, d in enumerate(domains)]
    mean = (total + 0.5 * len(domains)) / (n_rows + len(domains))
    weight = [F.greatest(F.lit(-4.0), F.least(F.lit(4.0), F.log(r / mean))) for r in rate]
    tells = sum(F.col(f"n_{i}") * w * w for i, w in enumerate(weight))
    strong = F.greatest(*[F.abs(w) for w in weight]) >= min_weight
    model = counts.where((total >= min_rows) & strong).select("term", *[w.alias(f"w_{i}") for i, w in enumerate(weight)], tells.alias("_tells"))
    return stored(model.orderBy(F.desc("_tells"), "term").limit(max_terms).drop("_tells"), "model"), log_prior


def _log(x: float) -> float:
    import math

    return math.log(x)


def posteriors(docs: DataFrame, model: DataFrame, log_prior: Mapping[str, float]) -> DataFrame:
    """``doc_id``, ``_h``, ``copies``, ``n_tokens`` and ``p``, the posterior in the order of ``log_prior``.

    Words meet the bounded model in a broadcast join and are summed up per document before the shuffle.  A document's
    first row carries its number of words; of the others only words that are in the model have anything to add.
    """
    k = len(log_prior)
    found = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"), F.array_remove(words(F.col("text")), "").alias("_found"))
    each = found.select("doc_id", "_h", F.size("_found").alias("_size"), F.posexplode_outer("_found").alias("_at", "_word"))
    size = F.when(F.coalesce("_at", F.lit(0)) == 0, F.col("_size")).alias("_size")
    scored = each.select("doc_id", "_h", size, term(F.col("_word")).alias("term")).join(F.broadcast(model), "term", "left")
    sums = scored.where("_size IS NOT NULL OR w_0 IS NOT NULL").groupBy("doc_id", "_h").agg(
        F.sum("_size").alias("_words"),
        F.count("_size").alias("copies"),
        *[F.sum(f"w_{i}").alias(f"s_{i}") for i in range(k)],
    )
    # long texts repeat their evidence, so it counts with the square root of their length
    calm = F.sqrt(F.greatest(F.lit(1.0), F.col("_words") / F.col("copies") / 25.0))
    logits = F.array(*[F.lit(p) + F.coalesce(F.col(f"s_{i}"), F.lit(0.0)) / F.col("copies") / calm for i, p in enumerate(log_prior.values())])
    lifted = F.transform(F.col("_logits"), lambda x: F.exp(x - F.array_max("_logits")))
    total = F.aggregate("_e", F.lit(0.0), lambda a, x: a + x)
    return (
        sums.select("doc_id", "_h", "copies", (F.col("_words") / F.col("copies")).cast("bigint").alias("n_tokens"), logits.alias("_logits"))
        .withColumn("_e", lifted)
        .select("doc_id", "_h", "copies", "n_tokens", F.transform("_e", lambda x: F.round(x / total, DIGITS)).alias("p"))
    )


def _replayed(steps: list[list[float]], p: Column) -> Column:
    """A document's rate after the steps: r <- max(0, r - p . g)."""
    if not steps:
        return F.lit(1.0)
    k = len(steps[0])
    history = F.array(*[F.array(*[F.lit(g) for g in step]) for step in steps])

    def step(r: Column, g: Column) -> Column:
        return F.greatest(F.lit(0.0), r - sum(p[i] * g[i] for i in range(k)))

    return F.aggregate(history, F.lit(1.0), step)


def fit_rates(members: DataFrame, targets: list[float], max_steps: int = 200, tolerance: float = 1e-6) -> tuple[list[list[float]], list[float]]:
    """Steps of projected gradient descent on the squared misfit, and what each domain is off its target in the end.

    ``targets`` and what is missed are shares of all tokens.  Documents with one posterior have one rate, so the
    steps read the tokens per posterior, a table whose size is bounded by the posterior's digits.
    ``max_steps`` only guards against a descent without end; reaching it raises an error.
    """
    k = len(targets)
    cells = stored(members.groupBy("p").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("w")), "cells")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def totals(steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens by domain, and the curvature: how a step on one domain moves another."""
        rated = cells.select("w", "p", _replayed(steps, F.col("p")).alias("r"))
        sums = [F.sum(F.col("w") * F.col("r") * F.col("p")[i]) for i in range(k)]
        sums += [F.sum(F.when(F.col("r") > 0, F.col("w") * F.col("p")[i] * F.col("p")[j])) for i, j in pairs]
        row = [float(x or 0.0) for x in rated.agg(*sums).first()]
        curve = np.zeros((k, k))
        for (i, j), x in zip(pairs, row[k:], strict=True):
            curve[i, j] = curve[j, i] = x
        return np.array(row[:k]), curve

    mass, curve = totals([])
    everything = mass.sum()
    if not everything:
        return [], [0.0] * k
    goal = np.array(targets) * everything

    def misfit(m: np.ndarray) -> float:
        return float(np.square((m - goal) / everything).sum())

    steps: list[list[float]] = []
    for _ in range(max_steps):
        off = mass - goal
        if np.abs(off).max() <= tolerance * everything:
            break
        heavy = np.where(curve.sum(axis=1) > 1e-9 * everything, curve.sum(axis=1), np.inf)
        found = None
        for way in (np.linalg.pinv(curve, rcond=1e-9, hermitian=True) @ off, off / heavy):
            for halvings in range(7):
                step = (way / 2**halvings).tolist()
                now, left = totals([*steps, step])
                if misfit(now) < misfit(mass) * (1 - 1e-9):
                    found = step, now, left
                    break
            if found:
                break
        if not found:
            break
        steps.append(found[0])
        mass, curve = found[1], found[2]
    else:
        raise RuntimeError(f"no end after {max_steps} steps, misfit {misfit(mass)}")
    return steps, ((mass - goal) / everything).tolist()


def mix(docs: DataFrame, domain_labels: DataFrame, targets: Mapping[str, float], max_rows: int = 20_000) -> DataFrame:
    """``doc_id``, ``n_tokens``, one posterior ``p_<domain>`` per target, ``rate`` and what each domain is ``off_<domain>`` its target, of every row."""
    domains = sorted(targets)
    model, prior = fit(docs, domain_labels, domains, max_rows)
    members = stored(posteriors(docs, model, prior), "members")
    steps, off = fit_rates(members, [targets[d] for d in domains])
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))
    rated = members.select("doc_id", "n_tokens", "p", _replayed(steps, F.col("p")).alias("rate"), each.alias("_copy"))
    shares = [F.lit(round(x, 9)).alias(f"off_{d}") for d, x in zip(domains, off, strict=True)]
    return rated.select("doc_id", "n_tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(domains)], F.round("rate", 6).alias("rate"), *shares)
