"""Token counts of a unigram tokenizer without building its tokens.

Pieces of a vocabulary are found by an Aho-Corasick automaton, and a Viterbi pass carries only the
best score and the number of pieces to each place.  Ties follow the tokenizer: at one end the match
that starts first is met first, and a later one wins only by a strictly better score.  A character
without a piece of its own costs ten below the worst score and falls back to its bytes.

Text is cut before each space as the tokenizer's pre-tokenizer does (``▁`` for a space, one in
front), so segments are independent and counts of frequent ones are remembered.

Defined cases: null and empty texts have 0 tokens and score 0; null ids stay; repeated rows are
counted each; an empty table gives an empty result; other columns can be carried with ``keep``.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harvestlake.session import ship_with_tasks

ship_with_tasks(__name__)

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Segments up to this many characters are remembered, this many at once; beyond, they are only computed again.
REMEMBER_CHARS, REMEMBER = 48, 400_000


class Counter:
    """Counts pieces of the best segmentation under a vocabulary of (piece, score)."""

    def __init__(self, vocabulary: Sequence[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.single: set[str] = set()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), float(score)))
                if len(piece) == 1:
                    self.single.add(piece)
        self.automaton.make_automaton()
        self.unknown = min(float(s) for _, s in vocabulary) - UNKNOWN_PENALTY
        self.known: dict[str, tuple[int, float]] = {}

    def segment(self, text: str) -> tuple[int, float]:
        """Tokens and score of the best path through one segment."""
        n = len(text)
        best: list[float | None] = [0.0] + [None] * n
        pieces = [0] * (n + 1)
        matches = self.automaton.iter(text)
        match = next(matches, None)
        for end in range(1, n + 1):
            top, count = None, 0
            # matches that end here come longest first, so the earliest start is met first
            while match is not None and match[0] == end - 1:
                size, score = match[1]
                start = end - size
                value = best[start] + score
                if top is None or value > top:
                    top, count = value, pieces[start] + 1
                match = next(matches, None)
            char = text[end - 1]
            if char not in self.single:
                value = best[end - 1] + self.unknown
                if top is None or value > top:
                    top, count = value, pieces[end - 1] + len(char.encode("utf-8", "surrogatepass"))
            best[end], pieces[end] = top, count
        return pieces[n], best[n]

    def count(self, text: str | None) -> tuple[int, float]:
        """Tokens and score of a whole text."""
        if not text:
            return 0, 0.0
        text = text.replace(" ", SPACE)
        if text[0] != SPACE:
            text = SPACE + text
        known, tokens, score = self.known, 0, 0.0
        for word in text.split(SPACE)[1:]:
            have = known.get(word)
            if have is None:
                have = self.segment(SPACE + word)
                if len(word) <= REMEMBER_CHARS:
                    if len(known) >= REMEMBER:
                        known.clear()
                    known[word] = have
            tokens += have[0]
            score += have[1]
        return tokens, score


def piece_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a public SentencePiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, vocabulary_path: str, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``n_tokens`` and ``best_score``.

    ``vocabulary_path`` names a file every machine has; each Python worker reads it once.
    """

    @F.pandas_udf(T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("best_score", T.DoubleType())]))
    def counts(texts: pd.Series) -> pd.DataFrame:
        if vocabulary_path not in _counters:
            _counters[vocabulary_path] = Counter(piece_vocabulary(vocabulary_path))
        counter = _counters[vocabulary_path]
        return pd.DataFrame([counter.count(t) for t in texts], columns=["n_tokens", "best_score"])

    rows = docs.select(*[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)], counts(F.col(text)).alias("_c"))
    kept = [F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep) if c not in ("n_tokens", "best_score")]
    return rows.select(*kept, "_c.n_tokens", "_c.best_score")
