"""Toxicity by a weighted finite-state grammar over clauses.

Words are read as symbols: insult, threat, target, negation, reported speech, quotation mark and other.  Five transducers,
each a small table of states, rewrite the symbols of a clause one after the other: negation marks the insults
and threats that a negation reaches, a few words ahead; reported speech marks those behind a reporting verb or an
open quotation mark; target, threat and insult remember what they have seen.  Their composition, one
automaton built once, reads a clause in one pass and ends in a state that says how many insults it has, and whether it
threatens, names a target, negates or reports.  Clauses, not single words, are scored: a final state weighs what its
clauses meant in labelled rows, and a document's score joins the clauses that matched as independent causes.

Insults are learned: words and word beginnings (other languages inflect them) that labelled toxic
rows have and clean rows hardly have.  Near copies count once (components of five-word shingles at 0.8), and
a term must be better evidence than the best of all terms is by chance, so rare terms pass if they are pure and
fragments of prose do not.  Learning reads at most ``max_rows`` labelled rows, chosen by a
hash of their id, and the model is at most ``max_terms`` terms and a fixed number of patterns, so
its size has a bound and it may travel with the tasks.

Defined cases: null and empty texts have no clause and get the score of a row without matches; null
ids are scored as any row, and are not held out; repeated rows are scored each; labels that disagree
count as toxic; an empty label table gives a model without insults; other columns are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harvestlake.llm import jaccard
from harvestlake.llm.common import stored
from harvestlake.session import ship_with_tasks

ship_with_tasks(__name__)

#: Closed word classes of the grammar, English, German, French and Spanish.
THREATS = frozenset("kill hurt destroy punish burn shoot töten umbringen vernichten tuer détruire frapper matar destruir golpear".split())
TARGETS = frozenset("you your yours you're they them dich euch ihr vous toi usted ustedes ellos".split())
NEGATIONS = frozenset("not no never don't isn't aren't nicht kein keine niemals pas jamais nunca tampoco".split())
REPORTS = frozenset("said says called calls claimed wrote quoted sagte schrieb nannte dit écrit appelle dijo escribió llamó".split())

NEGATION_REACH = 3
PREFIX_FROM, PREFIX_TO = 4, 7
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE_END = re.compile(r"[.!?;:,\n]")
_QUOTES = "\"“”„«»"
_READ = re.compile(rf"{_WORD.pattern}|[{_QUOTES}]")
_CLASSES = {w: x for x, words in (("T", THREATS), ("G", TARGETS), ("N", NEGATIONS), ("R", REPORTS)) for w in words}


@dataclass
class Model:
    """Insults as whole words and as word beginnings; what each clause pattern means."""

    words: frozenset[str] = frozenset()
    prefixes: frozenset[str] = frozenset()
    patterns: dict[tuple, float] = field(default_factory=dict)
    backoff: dict[int, float] = field(default_factory=dict)
    base: float = 0.0


def is_insult(word: str, model: Model) -> bool:
    return word in model.words or any(word[:k] in model.prefixes for k in range(PREFIX_FROM, min(PREFIX_TO, len(word)) + 1))


#: Symbols of words; a small letter is a negated insult or threat, the next letter of the alphabet a reported one.
INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, OTHER = "I", "T", "G", "N", "R", "Q", "o"
SYMBOLS = (INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, OTHER)
_REPORTED = {"I": "J", "i": "j", "T": "U", "t": "u"}
_HITS = ("I", "i", "J", "j", "T", "t", "U", "u")


@dataclass(frozen=True)
class Transducer:
    """A start state, and for a state and a symbol the next state and the symbol written."""

    start: object
    arcs: dict[tuple[object, str], tuple[object, str]]

    def run(self, symbols: list[str]) -> tuple[object, list[str]]:
        state, out = self.start, []
        for x in symbols:
            state, y = self.arcs[state, x]
            out.append(y)
        return state, out

    def compose(self, after: Transducer, symbols: tuple[str, ...] = SYMBOLS) -> Transducer:
        """One transducer that does what this and then ``after`` does; its states are the pairs that can be reached."""
        arcs, todo, seen = {}, [(self.start, after.start)], {(self.start, after.start)}
        while todo:
            a, b = todo.pop()
            for x in symbols:
                now, y = self.arcs[a, x]
                later, z = after.arcs[b, y]
                arcs[(a, b), x] = (now, later), z
                if (now, later) not in seen:
                    seen.add((now, later))
                    todo.append((now, later))
        return Transducer((self.start, after.start), arcs)


def negation_transducer() -> Transducer:
    """Insults and threats within ``NEGATION_REACH`` words of a negation become small letters; the state is the reach left."""
    arcs = {}
    for left in range(NEGATION_REACH + 1):
        for x in SYMBOLS:
            to = NEGATION_REACH if x == NEGATION else left if x == QUOTE else max(0, left - 1)
            arcs[left, x] = to, x.lower() if left and x in (INSULT, THREAT) else x
    return Transducer(0, arcs)


def speech_transducer() -> Transducer:
    """Insults and threats behind a reporting verb or a quotation mark are marked as reported."""
    arcs = {}
    for speech in (False, True):
        for x in (*SYMBOLS, "i", "t"):
            arcs[speech, x] = speech or x in (REPORT, QUOTE), _REPORTED.get(x, x) if speech else x
    return Transducer(False, arcs)


def target_transducer() -> Transducer:
    """Remembers a target."""
    return Transducer(False, {(seen, x): (seen or x == TARGET, x) for seen in (False, True) for x in (*SYMBOLS, *_HITS)})


def threat_transducer() -> Transducer:
    """Remembers a threat of any kind, and whether anything that hits was negated or reported."""
    arcs = {}
    for threat in (False, True):
        for negated in (False, True):
            for reported in (False, True):
                for x in (*SYMBOLS, *_HITS):
                    state = threat or x in "TtUu", negated or x in ("i", "j", "t", "u"), reported or x in ("J", "j", "U", "u")
                    arcs[(threat, negated, reported), x] = state, x
    return Transducer((False, False, False), arcs)


def insult_transducer(most: int = 3) -> Transducer:
    """Counts insults of any kind, up to ``most``."""
    return Transducer(0, {(n, x): (min(most, n + (x in ("I", "i", "J", "j"))), x) for n in range(most + 1) for x in (*SYMBOLS, *_HITS)})


def grammar() -> Transducer:
    """The five transducers composed."""
    out = negation_transducer()
    for t in (speech_transducer(), target_transducer(), threat_transducer(), insult_transducer()):
        out = out.compose(t)
    return out


def pattern_of(state: object) -> tuple[int, bool, bool, bool, bool] | None:
    """(insults, threat, target, negated, reported) of a final state; none without insult or threat."""
    (((_, _), target), (threat, negated, reported)), insults = state
    return (insults, threat, target, negated, reported) if insults or threat else None


GRAMMAR = grammar()


def symbols_of(clause: str, model: Model) -> list[str]:
    """Symbols of a lower-case clause's words and quotation marks."""
    out = []
    for m in _READ.finditer(clause):
        word = m[0]
        if word in _QUOTES:
            out.append(QUOTE)
        elif is_insult(word, model):
            out.append(INSULT)
        else:
            out.append(_CLASSES.get(word, OTHER))
    return out


def clause_pattern(clause: str, model: Model) -> tuple[int, bool, bool, bool, bool] | None:
    """(insults up to 3, threat, target, negated, reported) of a lower-case clause; none without insult or threat."""
    state, arcs = GRAMMAR.start, GRAMMAR.arcs
    for x in symbols_of(clause, model):
        state = arcs[state, x][0]
    return pattern_of(state)


class Matcher:
    """Finds the clauses of a text that can match; only those run through the grammar."""

    def __init__(self, model: Model):
        import ahocorasick

        self.model = model
        self.automaton = ahocorasick.Automaton()
        for w in model.words | model.prefixes | THREATS:
            self.automaton.add_word(w, len(w))
        if len(self.automaton):
            self.automaton.make_automaton()

    def patterns(self, text: str | None) -> list[tuple]:
        if not text or not len(self.automaton):
            return []
        low, found, upto = text.lower(), [], -1
        for end, size in self.automaton.iter(low):
            start = end - size + 1
            if start < upto or (start and low[start - 1].isalpha()):
                continue
            left = max((low.rfind(c, max(0, upto), start) for c in ".!?;:,\n"), default=-1) + 1
            right = _CLAUSE_END.search(low, end + 1)
            upto = right.start() if right else len(low)
            p = clause_pattern(low[max(left, 0) : upto], self.model)
            if p:
                found.append(p)
        return found

    def score(self, text: str | None) -> float:
        clean = 1.0 - self.model.base
        for p in self.patterns(text):
            clean *= 1.0 - self.model.patterns.get(p, self.model.backoff.get(p[0], 0.0))
        return 1.0 - clean


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that learning must not see: crc32 of the id as text leaves 1 modulo 3; null ids are not among them."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _features(text: str) -> set[str]:
    out = set()
    for w in set(_WORD.findall(text.lower())):
        out.add("=" + w)
        out.update(w[:k] for k in range(PREFIX_FROM, min(PREFIX_TO, len(w)) + 1))
    return out


def _choose(rows: list[tuple[str, int]]) -> tuple[set[str], set[str]]:
    """Of nested terms with nearly equal support the longest, of others the shortest."""
    support = dict(rows)
    words, prefixes = set(), set()
    for term in sorted(support, key=lambda t: (len(t.lstrip("=")), t.startswith("="))):
        bare = term.lstrip("=")
        if any(bare[:k] in prefixes for k in range(PREFIX_FROM, len(bare) + 1)):
            continue
        if term.startswith("="):
            words.add(bare)
            continue
        longer = [t for t in support if t != term and t.lstrip("=").startswith(term) and support[t] >= 0.98 * support[term]]
        if not longer:
            prefixes.add(term)
    return words, prefixes


def labelled_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """``text`` and ``toxic`` of at most about ``max_rows`` rows that are not held out, near copies of one label once.

    The sampled ids are bounded, so they are broadcast and the texts do not move.
    """
    one = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    share = min(1.0, max_rows / max(1, one.count()))
    picked = one.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = stored(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")), "labelled")
    families = jaccard.join_components(rows, width=5, percent=80).groupBy("doc_id").agg(F.min("component_id").alias("family"))
    first = F.min_by(F.struct("text"), F.struct("doc_id", "text")).alias("row")
    return stored(rows.join(families, "doc_id").groupBy("family", "toxic").agg(first).select("row.text", "toxic"), "families")


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_terms: int = 2_000, purity: float = 0.95, doubt: float = 1.0, support: int = 3) -> Model:
    """Learn insults and pattern weights from rows that are not held out.

    A term is in ``t`` toxic of ``n`` rows.  By chance that is at most ``exp(-n KL(t/n, share of toxic rows))`` likely; over
    all terms that are frequent enough to pass at all, the expected number that does so by chance is at most ``doubt``.  Fewer than ``support`` rows are never enough.
    """
    rows = labelled_rows(docs, labels, max_rows)

    def count_features(batches):
        for b in batches:
            both = [Counter(), Counter()]
            for text, toxic in zip(b["text"], b["toxic"], strict=True):
                if text:
                    both[int(toxic > 0)].update(_features(text))
            terms = list(both[1])  # terms that no toxic row has are of no use, but their clean count is for the others
            clean = [t for t in both[0] if t not in both[1]]
            yield pd.DataFrame({
                "term": terms + clean,
                "toxic": [both[1][t] for t in terms] + [0] * len(clean),
                "clean": [both[0][t] for t in terms] + [both[0][t] for t in clean],
            })

    shares = rows.agg(F.count("*").alias("n"), F.sum((F.col("toxic") > 0).cast("bigint")).alias("toxic")).first()
    rate = ((shares["toxic"] or 0) + 0.5) / (shares["n"] + 1.0)
    counted = rows.mapInPandas(count_features, "term string, toxic bigint, clean bigint").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counted = stored(counted.where("toxic > 0"), "terms")
    n, t = F.col("toxic") + F.col("clean"), F.col("toxic")
    clean_part = F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / n / (1 - rate))).otherwise(0.0)
    sure = t * F.log(t / n / rate) + clean_part
    by_size = {r["n"]: r["terms"] for r in counted.groupBy(F.least(n, F.lit(64)).alias("n")).agg(F.count("*").alias("terms")).collect()}
    tested = next((v for k in range(1, 65) if (v := sum(c for size, c in by_size.items() if size >= k)) * rate**k <= doubt), 1)
    pure = counted.where((t >= support) & (t >= purity * n) & (sure >= math.log(max(1, tested) / doubt)))
    top = pure.orderBy(F.desc("toxic"), "term").limit(max_terms).collect()
    words, prefixes = _choose([(r["term"], r["toxic"]) for r in top])
    model = Model(frozenset(words), frozenset(prefixes))

    def count_patterns(batches):
        matcher = Matcher(model)
        for b in batches:
            seen = Counter()
            for text, toxic in zip(b["text"], b["toxic"], strict=True):
                found = set(matcher.patterns(text))
                for key in [("rows",), *found] + ([] if found else [("none",)]):
                    seen[(",".join(str(int(x)) if not isinstance(x, str) else x for x in key), int(toxic > 0))] += 1
            yield pd.DataFrame([(k, t, n) for (k, t), n in seen.items()], columns=["pattern", "toxic", "n"])

    counts: dict[str, list[int]] = {}
    for r in rows.mapInPandas(count_patterns, "pattern string, toxic int, n bigint").groupBy("pattern", "toxic").agg(F.sum("n").alias("n")).collect():
        counts.setdefault(r["pattern"], [0, 0])[r["toxic"]] = r["n"]
    clean, toxic = counts.pop("rows", [0, 0])
    prior = toxic / max(1, clean + toxic)
    none = counts.pop("none", [0, 0])
    model.base = (none[1] + prior) / (sum(none) + 1)

    def excess(c: float, t: float) -> float:
        p = (t + prior) / (c + t + 1)
        return max(0.0, (p - prior) / (1 - prior)) if prior < 1 else 1.0

    levels: dict[int, list[int]] = {}
    for key, (c, t) in counts.items():
        p = tuple(int(x) for x in key.split(","))
        model.patterns[(p[0], *map(bool, p[1:]))] = excess(c, t)
        at = levels.setdefault(p[0], [0, 0])
        at[0] += c
        at[1] += t
    model.backoff = {k: excess(c, t) for k, (c, t) in levels.items()}
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row, from its text alone."""

    @F.pandas_udf(T.DoubleType())
    def rate(texts: pd.Series) -> pd.Series:
        matcher = Matcher(model)
        return pd.Series([matcher.score(t) for t in texts], dtype=np.float64)

    rated = docs.select("doc_id", rate(F.col("text")).alias("score"))
    return rated.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
