"""Quality rules with a bitmask ledger.

``rule_ledger`` measures every text once (one Arrow pass) and evaluates every
rule once, as a DataFrame expression over the measurements: bit ``k`` of
``fail_bits`` is set where rule ``k`` fails.  Policies are versioned sets of
rules; ``apply_policy`` and ``ablations`` work on the stored bits alone, so a
new policy never reads a text again.

Defined results: a null text has no words and all measurements 0 (it fails
``few_words``); repeated rows are judged one by one; an empty table gives an
empty ledger; other columns are passed through, whatever their names (the
ledger's own columns replace columns of the same name).
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank_words, session_of

SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines", "n_distinct_words", "n_alpha_words", "longest_word", "top_word", "n_stutter")
_TYPE = pa.struct([(m, pa.int64()) for m in MEASURES])


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words inside a window of ``window`` words that occurs twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) > len(words) - window:  # a repeated window repeats at least ``window`` words
        return 0
    have = 1
    while have < window:  # names of longer runs from the names of two shorter ones: exact, no hashing
        step = min(have, window - have)
        pairs = ids[:-step] * (int(ids.max()) + 1) + ids[step:]
        ids = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        have += step
    starts = np.flatnonzero(np.bincount(ids)[ids] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(edges)))


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``."""
    words = blank_words(text)
    if not words:
        return (0,) * len(MEASURES)
    raw = text.encode()
    lines = [line for line in raw.split(b"\n") if line.split()]
    counts = Counter(words)
    joined = b"".join(words)
    return (len(words), len(joined.decode()), len(raw) - len(raw.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words), len(lines), len(counts),
            sum(n for w, n in counts.items() if w[0] > 127 or w[:1].isalpha()),
            max(map(len, counts)), max(counts.values()), sum(map(bytes.__eq__, words, words[1:])))


def _measure_batch(texts: pa.Array) -> pa.Array:
    rows = [measure(t.as_py()) for t in texts]
    columns = np.array(rows, np.int64).reshape(len(rows), len(MEASURES)).T
    return pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(_TYPE))


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Column | str  # SQL text over the measurements


#: Bit k of the ledger is rule k; new rules are appended, so that stored bits keep their meaning.
RULES: tuple[Rule, ...] = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("many_symbols", "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 25 * n_words"),
    Rule("few_alpha_words", "2 * n_alpha_words < n_words"),
    Rule("one_word_dominates", "n_words >= 50 AND 2 * top_word > n_words"),
    Rule("longest_word", "longest_word > 1000"),
    Rule("stutter", "2 * n_stutter > n_words"),
)

#: Policy versions: the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": ("few_words", "repeated_windows"),
    "v2": ("few_words", "repeated_windows", "many_symbols", "repeated_lines", "word_length",
           "few_alpha_words", "one_word_dominates", "longest_word", "stutter"),
}


def mask_of(policy: str, rules: tuple[Rule, ...] = RULES) -> int:
    place = {r.name: k for k, r in enumerate(rules)}
    return sum(1 << place[name] for name in POLICIES[policy])


def rule_ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the measurements and ``fail_bits`` (BIGINT, at most 63 rules)."""
    if len(rules) > 63:
        raise ValueError("a ledger holds at most 63 rules")
    session_of(docs)
    udf = F.arrow_udf(_measure_batch, "struct<" + ", ".join(f"{m}: bigint" for m in MEASURES) + ">")
    own = [c for c in docs.columns if c not in MEASURES and c != "fail_bits"]
    measured = docs.withColumn("fail_bits", udf(F.col(f"`{text}`"))).select(
        *[F.col(f"`{c}`") for c in own], *[F.col(f"fail_bits.{m}").alias(m) for m in MEASURES])
    bits = [F.when(F.expr(r.fails) if isinstance(r.fails, str) else r.fails, F.lit(1 << k)).otherwise(F.lit(0))
            .cast("bigint") for k, r in enumerate(rules)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured.withColumn("fail_bits", total)


def apply_policy(ledger: DataFrame, policy: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with ``kept``: no rule of the policy fails."""
    return ledger.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask_of(policy, rules))) == 0)


def ablations(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per policy and rule: documents that fail it, that only it rejects, and that
    stay rejected without it.

    The ledger is first counted by ``fail_bits``; policies are then compared on
    those few distinct masks.
    """
    masks = ledger.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    plan = [(p, mask_of(p, rules), r.name, 1 << k) for p in POLICIES for k, r in enumerate(rules) if r.name in POLICIES[p]]
    entries = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(m).cast("bigint").alias("mask"),
                                 F.lit(r).alias("rule"), F.lit(b).cast("bigint").alias("bit")) for p, m, r, b in plan])
    each = masks.select("fail_bits", "n", F.explode(entries).alias("e")).select("fail_bits", "n", "e.*")
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    rest = hit.bitwiseAND(F.bitwise_not(F.col("bit")))
    count = lambda when: F.sum(F.when(when, F.col("n")).otherwise(F.lit(0)))
    return each.groupBy("policy", "rule").agg(
        count(F.col("fail_bits").bitwiseAND(F.col("bit")) != 0).alias("n_fail"),
        count(hit == F.col("bit")).alias("n_only"),
        count(rest != 0).alias("n_rejected_without"),
        count(hit != 0).alias("n_rejected"))
