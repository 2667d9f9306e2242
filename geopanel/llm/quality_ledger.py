"""Quality rules as a ledger of failure bits.

One pass measures every text and evaluates every rule once. The ledger keeps the measurements and one bit for each failed
rule. A policy is a versioned mask over those bits: applying another policy, or asking what a rule alone removes, is bitwise
arithmetic on the stored column and never touches a text again.

Defined results: null text counts as empty; an empty text has zero words and fails ``too_short``; rows with a null or repeated
identifier are measured like any other, one ledger row for each input row; an empty table gives an empty ledger. Texts of any
length are measured whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geopanel.llm.common import SPACE, texts

SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
_UPPER, _LOWER, _DIGITS = (bytes(range(ord(a), ord(b) + 1)) for a, b in ("AZ", "az", "09"))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_marks", "n_distinct_words")

#: Bit -> (name, failing condition over the measurements). Bits are never reused: a changed rule gets a new one.
RULES: dict[int, tuple[str, str]] = {
    0: ("too_short", "n_words < 10"),
    1: ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    2: ("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    3: ("symbols", "10 * n_symbols > n_words"),
    4: ("repeated_lines", "n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines"),
    5: ("shouting", "2 * n_upper > n_letters"),
    6: ("digits", "2 * n_digits > word_chars"),
    7: ("exclamations", "5 * n_marks > n_words"),
    8: ("few_letters", "2 * n_letters < word_chars AND n_letters < n_words"),
    9: ("few_distinct_words", "n_words >= 20 AND 2 * n_distinct_words * n_distinct_words < 5 * n_words"),
}
#: Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_short", "repeated_windows"),
    "v1": ("too_short", "repeated_windows", "symbols", "repeated_lines"),
    "v2": ("too_short", "repeated_windows", "word_length", "symbols", "repeated_lines", "shouting", "digits", "exclamations", "few_letters", "few_distinct_words"),
}


def _marginal(codes: np.ndarray) -> np.ndarray:
    return np.unique(codes, return_inverse=True)[1].astype(np.int64)


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words covered by windows that occur at least twice in the text. Windows get exact numbers by joining the numbers of
    two shorter ones, so no hash can confuse them."""
    n = len(words)
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if n <= window or len(index) == n:
        return 0
    word = np.fromiter(map(index.__getitem__, words), np.int64, n)
    code, width = word, 1
    while width < window:
        step = min(width, window - width)
        nxt = code if step == width else word
        m = n - width - step + 1
        code = _marginal(code[:m] * n + nxt[width : width + m])
        width += step
        if step == width - step and code.max() == m - 1 == code.size - 1:
            return 0  # all windows of this width differ, and so do all wider ones
    seen = np.bincount(code)[code] > 1
    if not seen.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    edge[: seen.size] += seen
    edge[window : window + seen.size] -= seen
    return int(np.count_nonzero(np.cumsum(edge)))


def measure(raw: bytes) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    upper = count(_UPPER)
    return (
        len(words), len(raw.translate(None, _CONTINUATION + SPACE)), count(SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), len(lines),
        upper, upper + count(_LOWER), count(_DIGITS), raw.count(b"!"), len(set(words)),
    )


def measurements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and MEASURES of every row."""

    def run(batches):
        for b in batches:
            rows = [measure(t) for t in b.column("text").cast(pa.binary()).to_pylist()]
            cols = list(zip(*rows)) or [()] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", *MEASURES])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))


def mask(rules: tuple[str, ...]) -> int:
    bits = {name: 1 << bit for bit, (name, _) in RULES.items()}
    return sum(bits[r] for r in rules)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and ``failures``: bit b is set if rule b fails."""
    bits = [F.when(F.expr(test), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long") for bit, (_, test) in RULES.items()]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measurements(docs, id_col, text_col).withColumn("failures", total)


def passes(policy: str) -> Column:
    """Verdict of a policy on a ledger row."""
    return F.col("failures").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents it fails, documents that it alone fails, and documents kept without it.

    The ledger is first counted by failure pattern (2 to the number of rules at most), so the arithmetic runs on a few rows.
    """
    whole = mask(POLICIES[policy])
    patterns = rows.groupBy("failures").agg(F.count(F.lit(1)).alias("n"))
    own = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << bit).cast("long").alias("bit")) for bit, (name, _) in RULES.items() if name in POLICIES[policy]])
    bad = F.col("failures").bitwiseAND(F.lit(whole))
    each = patterns.withColumn("r", F.explode(own)).select("n", bad.alias("bad"), "r.rule", "r.bit")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return each.groupBy("rule").agg(
        total(F.col("bad").bitwiseAND(F.col("bit")) != 0).alias("fails"),
        total(F.col("bad") == F.col("bit")).alias("fails_alone"),
        total((F.col("bad") == 0) | (F.col("bad") == F.col("bit"))).alias("kept_without"),
    )
