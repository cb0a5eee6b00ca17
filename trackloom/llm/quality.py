"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document, under no policy yet: the ledger holds the measurements and one bit for each
rule that fails. A policy is a versioned set of rules, that is a mask; applying it, comparing two of them or asking what a
rule alone rejects are bitwise operations on the ledger, without reading a text again.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .substring import _mix, _Powers

WINDOW = 8
#: The characters that count as symbols, and those that separate words.
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\x0b\x0c\r"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")
#: Rule -> condition of failure, over the measures. A rule's bit is its place in this table; new rules go at the end.
RULES = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "100 * n_symbols > 5 * word_chars",
    "shouting": "n_letters >= 40 and 100 * n_upper > 60 * n_letters",
    "repeated_lines": "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines",
    "long_words": "word_chars > 25 * n_words",
    "short_words": "word_chars < 2 * n_words",
}
BASE = ("few_words", "repeated_windows")
#: Policies by version; a published version never changes.
POLICIES = {"base": BASE, "v1": (*BASE, "symbols", "shouting", "repeated_lines", "long_words", "short_words")}
CURRENT = "v1"

_UPPER, _LETTER = re.compile(r"[A-ZÀ-ÖØ-ÞΑ-ΩА-Я]"), re.compile(r"[^\W\d_]")


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that stand in a window found twice or more, the first included."""
    n = len(words)
    if n <= window:
        return 0
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words, repeat(7)), np.uint64, n)
    up, down = _Powers.to(n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * down)])
    whole = _mix((total[window:] - total[:-window]) * up[window - 1 :])
    order = np.sort(whole)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(whole, twice))
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    raw = text.encode()
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        len(_UPPER.findall(text)),
        len(_LETTER.findall(text)),
    )


def _measures(batches):
    for batch in batches:
        rows = [measure(x.as_py() or "") for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], pa.int64()) for i in range(len(MEASURES))]], names=["doc_id", *MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, the measures, and ``failed``, the bits of the rules that fail.

    Null text counts as empty: no words, so it fails few_words. Rows that repeat a doc_id have their own rows. An empty
    table gives an empty one; columns besides doc_id and text are ignored.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(m, T.LongType()) for m in MEASURES]])
    measured = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_measures, schema)
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured.withColumn("failed", failed.cast("long"))


def mask(policy: str = CURRENT) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in POLICIES[policy])


def fails(policy: str = CURRENT, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(mask(policy))) != 0


def ablations(led: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that would be kept without it.

    Distinct bit sets are counted first (there are at most 2 ** rules), then read bitwise for every rule.
    """
    sets = led.groupBy(F.col("failed").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count("*").alias("n"))
    names = list(RULES)
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in POLICIES[policy]])
    each = sets.select("bits", "n", F.explode(rules).alias("r"))
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    rest = F.col("bits").bitwiseAND(F.bitwise_not("r.bit"))
    return each.groupBy("r.rule").agg(n(F.col("bits").bitwiseAND(F.col("r.bit")) != 0).alias("fails"), n(F.col("bits") == F.col("r.bit")).alias("fails_alone"), n(rest == 0).alias("kept_without"))
