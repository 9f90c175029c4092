"""Quality rules whose cutoffs come with a guarantee on false rejection.

``measure`` counts, for each whole text, what the rules look at. ``cutoffs``
takes labelled documents (1: good) by stratum. A cutoff of a rule is *certified*
when an exact binomial test shows that it rejects at most ``alpha / rules`` of
the stratum's good documents: with k of n good ones rejected, the probability
of k or fewer under that rate is at most ``delta`` divided by the number of
strata, rules and candidate cutoffs tested (Bonferroni). So with probability
1 - delta all strata lose at most ``alpha`` of their good documents. Among
certified cutoffs the one that rejects the most bad documents is taken, the
most lenient of equals; without any, the rule rejects nothing there.

Every labelled row counts; the driver sees one row of counts for each stratum
(at most ``MAX_STRATA``, or ValueError).

Defined results: a null or empty text has zero counts and fails the base rule;
a null stratum is a stratum of its own; a document with several labels is good
if one says so, null labels are ignored; no labels at all: only the base rule.
"""

from __future__ import annotations

from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexafact.llm.mapping import add_columns
from hexafact.llm.text import IS_SPACE, hash_words, mix, split_words, windowed, windows

ALPHA = 0.02
DELTA = 0.05
MAX_STRATA = 10_000
MIN_WORDS = 50
REPEAT_PERCENT = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_exclaim")


def _per_doc(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def _repeated_words(first: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Words inside 3-word windows that occur more than once in their document."""
    n = len(first) - 1
    start, doc = windows(first, 3)
    if not len(start):
        return np.zeros(n, np.int64)
    key = windowed(words, 3)[start]
    key = mix(key ^ mix(doc.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = start[twice]
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[at + k] = True
    return _per_doc(covered, first)


def _lines(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those among them equal to an earlier one, per document."""
    n = len(offs) - 1
    if not len(data):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    breaks = np.flatnonzero(data == 10)
    start = np.concatenate([offs[:-1], breaks + 1])
    start.sort(kind="stable")
    doc = np.searchsorted(offs[1:], start, "right")
    keep = doc < n
    # a line break at a document's very end starts an empty line, which has no word
    start, doc = start[keep], doc[keep]
    limit = offs[1:][doc]
    end = np.minimum(np.append(start[1:] - 1, len(data)), limit)
    last = np.append(doc[1:] != doc[:-1], True)
    end[last] = limit[last]
    end = np.maximum(end, start)
    solid = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~IS_SPACE[data], out=solid[1:])
    word = solid[end] > solid[start]
    start, end, doc = start[word], end[word], doc[word]
    count = np.bincount(doc, minlength=n)
    raw, edge = data.tobytes(), np.append(0, np.cumsum(count)).tolist()
    lines = [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    return count, count - np.array([len(set(lines[a:b])) for a, b in zip(edge[:-1], edge[1:], strict=True)], np.int64)


def _measured(rows: pa.RecordBatch, data: np.ndarray, offs: np.ndarray) -> dict:
    words = split_words(data, offs)
    lines, again = _lines(data, offs)
    return {
        "n_words": np.diff(words.first),
        "word_chars": _per_doc(~IS_SPACE[data] & ((data & 0xC0) != 0x80), offs),
        "n_symbols": _per_doc(_SYMBOL[data], offs),
        "n_dup_lines": again,
        "n_repeat_words": _repeated_words(words.first, hash_words(data, words)) if len(words.start) else np.zeros(len(offs) - 1, np.int64),
        "n_lines": lines,
        "n_upper": _per_doc(_UPPER[data], offs),
        "n_lower": _per_doc(_LOWER[data], offs),
        "n_exclaim": _per_doc(data == ord("!"), offs),
    }


def measure(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns in ``keep`` and the counts of each whole text."""
    return add_columns(docs, _measured, [T.StructField(c, T.LongType()) for c in COUNTS], text, keep)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def _ratio(a: str, b: Column) -> Column:
    return F.col(a) / F.greatest(b, F.lit(1)).cast("double")


#: name: (value, candidate cutoffs); a document is rejected when its value is above the cutoff
RULES: dict[str, tuple[Column | str, list[float]]] = {
    "symbols": ("n_symbols / cast(greatest(n_words, 1) as double)", [0.01 * 1.3**k for k in range(20)]),
    "capitals": ("n_upper / cast(greatest(n_upper + n_lower, 1) as double)", [0.05 * k for k in range(1, 20)]),
    "exclaims": ("n_exclaim / cast(greatest(n_words, 1) as double)", [0.01 * 1.4**k for k in range(16)]),
    "same_lines": ("n_dup_lines / cast(greatest(n_lines, 1) as double)", [0.05 * k for k in range(1, 20)]),
    "repeats": ("n_repeat_words / cast(greatest(n_words, 1) as double)", [0.05 * k for k in range(1, 11)]),
}


def tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p)."""
    if n <= 0 or k >= n:
        return 1.0
    i = np.arange(k + 1)
    logs = np.array([lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) for x in i.tolist()]) + i * log(p) + (n - i) * np.log1p(-p)
    top = logs.max()
    return float(min(1.0, np.exp(top) * np.exp(logs - top).sum()))


def cutoffs(labelled: DataFrame, stratum: str, label: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> dict[str | None, dict[str, float]]:
    """Certified cutoffs: stratum -> rule -> cutoff. ``labelled`` has the counts, the stratum and the label."""
    good = (F.col(label) == 1).cast("long")
    sums = [F.sum(good).alias("good")]
    for name, (value, steps) in RULES.items():
        for i, c in enumerate(steps):
            over = (F.expr(value) > F.lit(c)).cast("long")
            sums += [F.sum(good * over).alias(f"{name}_{i}_good"), F.sum((1 - good) * over).alias(f"{name}_{i}_bad")]
    rows = labelled.where(F.col(label).isNotNull() & ~base_failed()).groupBy(stratum).agg(*sums).limit(MAX_STRATA + 1).collect()
    if len(rows) > MAX_STRATA:
        raise ValueError(f"more than {MAX_STRATA} strata")
    tests = max(1, len(rows)) * sum(len(s) for _, s in RULES.values())
    rate = alpha / len(RULES)
    out: dict[str | None, dict[str, float]] = {}
    for row in rows:
        own = out[row[stratum]] = {}
        for name, (_, steps) in RULES.items():
            best = 0
            for i in reversed(range(len(steps))):
                if row[f"{name}_{i}_bad"] > best and tail(row[f"{name}_{i}_good"], row["good"], rate) <= delta / tests:
                    best, own[name] = row[f"{name}_{i}_bad"], steps[i]
    return out


def verdict(found: dict[str | None, dict[str, float]], stratum: str) -> Column:
    """True where no certified cutoff is exceeded."""
    kept = F.lit(True)
    for name, (value, _) in RULES.items():
        by = [(s, own[name]) for s, own in found.items() if name in own]
        if by:
            limit = F.coalesce(*[F.when(F.col(stratum).eqNullSafe(F.lit(s)), F.lit(c)) for s, c in by], F.lit(float("inf")))
            kept = kept & (F.expr(value) <= limit)
    return kept
