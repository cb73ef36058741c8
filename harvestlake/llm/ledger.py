"""Rule bitmask ledger: every quality rule is evaluated once; policies and ablations read its bits.

The ledger keeps, per document, the measurements and one bit per failed rule.  A policy is a
versioned list of rules, so judging by another policy, or asking what a rule alone removes,
is bitwise arithmetic on the ledger and reads no text again.

Defined cases: a null or empty text has no words, fails ``few_words`` and so is rejected; a null
id is kept as it is; repeated rows are judged each by itself; an empty table gives an empty
ledger; columns of the input that bear a name of the ledger are left out of it, others may be
carried with ``keep``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harvestlake.llm import kernels
from harvestlake.session import ship_with_tasks

ship_with_tasks(__name__)

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower", "n_stutter")
SYMBOLS = b"#*$%&|<>"

#: Name and SQL condition of every rule; a rule's bit is its place here, so only append.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 25 * n_words"),
    ("shouting", "n_upper > n_lower"),
    ("repeated_lines", "n_lines >= 4 AND 100 * n_dup_lines > 60 * n_lines"),
    ("stutter", "2 * n_stutter > n_words"),
)
#: Rules by which a policy rejects; versions are never changed, only added.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "shouting", "repeated_lines", "stutter"),
}


def measure_text(text: str | None) -> tuple[int, ...]:
    """Measurements of one whole text, in the order of ``MEASURES``."""
    data = kernels.as_bytes(text)
    if not len(data):
        return (0,) * len(MEASURES)
    count = np.bincount(data, minlength=256)
    blanks = int(count[0x20] + count[0x09:0x0E].sum())
    points = len(data) - int(count[0x80:0xC0].sum())
    words = kernels.word_hashes(data.tobytes(), fold=False)
    lines = [x for x in data.tobytes().split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return (
        len(words),
        points - blanks,
        int(sum(count[s] for s in SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
        int(count[65:91].sum()),
        int(count[97:123].sum()),
        int((words[1:] == words[:-1]).sum()),
    )


def repeated_words(words: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows that occur at least twice."""
    count = len(words) - window + 1
    if count < 2:
        return 0
    total = np.zeros(count, np.uint64)
    for k in range(window):
        total += words[k : k + count] * np.uint64(pow(kernels.MULTIPLIERS[1], k, 1 << 64))
    ordered = np.sort(total)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(total, twice))
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


@F.pandas_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
def _measure(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure_text(t) for t in texts], columns=list(MEASURES), dtype="int64")


def mask_of(policy: str) -> int:
    names = [n for n, _ in RULES]
    return sum(1 << names.index(n) for n in POLICIES[policy])


def ledger(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the measurements and ``failures``, one bit for each failed rule."""
    measured = docs.select(*[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)], _measure(F.col(text)).alias("_m"))
    flat = measured.select(*[F.col(f"_keep_{i}") for i in range(len(keep))], "_m.*")
    bits = [F.when(F.expr(cond), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for i, (_, cond) in enumerate(RULES)]
    failures = bits[0]
    for b in bits[1:]:
        failures = failures.bitwiseOR(b)
    fresh = [c for c in flat.columns if not c.startswith("_keep_")]
    return flat.select(*[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep) if c not in (*fresh, "failures")], *fresh, failures.alias("failures"))


def fails(policy: str) -> Column:
    """Whether a row of the ledger is rejected by a policy."""
    return F.col("failures").bitwiseAND(F.lit(mask_of(policy)).cast("bigint")) != 0


def ablation(book: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of the policy: documents that fail it, and those that only it rejects.

    The ledger shrinks to one row per distinct bit pattern first, at most 2^rules.
    """
    mask = mask_of(policy)
    patterns = book.groupBy(F.col("failures").bitwiseAND(F.lit(mask).cast("bigint")).alias("bits")).agg(F.count("*").alias("n"))
    rules = [(n, 1 << i) for i, (n, _) in enumerate(RULES) if n in POLICIES[policy]]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("bigint").alias("bit")) for n, b in rules])).alias("r")
    return (
        patterns.select("bits", "n", each)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
        )
    )


def reject(docs: DataFrame, policy: str = "v1", text: str = "text") -> DataFrame:
    """The documents that the policy keeps by the bits of their ledger, with all their columns, whatever their names."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    return ledger(rows, keep=("row",)).where(~fails(policy)).select("row.*")
