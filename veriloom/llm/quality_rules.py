"""Quality rules: text statistics and a learned decision list.

Statistics come from whole texts.  The list is learned by sequential covering:
a conjunction of thresholds is grown on two thirds of the labelled rows by
information gain, pruned on the rest, and kept while it is precise enough; the
rows it covers leave and the next is grown.  The rules become one ordered Spark
conditional expression, so judging stays inside Spark.

Defined results: a null or empty text has all statistics 0 (and so fails the
base rule); repeated rows each give a row; an empty table gives an empty result;
other columns are neither read nor returned; a null id stays null.  Without
labelled rows of both classes the list is empty and keeps every document.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.llm.columns import map_texts

SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_distinct", "n_marks", "n_lines")
#: Ratios that rules test, each of one count to another.
FEATURES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "distinct_share": ("n_distinct", "n_words"),
    "marks_per_word": ("n_marks", "n_words"),
    "word_length": ("word_chars", "n_words"),
}


def text_stats(text: str) -> tuple[int, ...]:
    """The counts of ``STATS`` for one whole text."""
    raw = text.encode()
    words = raw.split()  # ASCII white space only
    n = len(words)
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    dup = len(lines) - len(set(lines))
    repeat = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(seen := set(windows)) < len(windows):
            once: set = set()
            twice = set()
            for w in windows:
                (twice if w in once else once).add(w)
            covered = bytearray(n)
            for i, w in enumerate(windows):
                if w in twice:
                    covered[i] = covered[i + 1] = covered[i + 2] = 1
            repeat = sum(covered)
        del seen
    data = np.frombuffer(raw, np.uint8)
    upper = int(((data >= 65) & (data <= 90)).sum())
    return n, chars, symbols, dup, repeat, upper, len(set(words)), text.count("!") + text.count("?"), len(lines)


def statistics(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the counts of ``STATS`` for every row."""
    return map_texts(df, lambda: lambda texts: list(map(list, zip(*map(text_stats, texts)))), ", ".join(f"{s} bigint" for s in STATS), id_col, text_col)


def base_failed() -> Column:
    """The fixed rule over the statistics."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


class Test(NamedTuple):
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        top, bottom = FEATURES[self.feature]
        ratio = F.col(top) / F.when(F.col(bottom) > 0, F.col(bottom)).otherwise(F.lit(1))
        return ratio > self.threshold if self.above else ratio <= self.threshold


class Rule(NamedTuple):
    """Rejects the documents that pass every test."""

    tests: tuple[Test, ...]
    covered: int
    precision: float

    def __str__(self) -> str:
        return " and ".join(f"{t.feature} {'>' if t.above else '<='} {t.threshold:.6g}" for t in self.tests)


def ratios(stats: np.ndarray) -> np.ndarray:
    """Features of rows of ``STATS``."""
    at = {s: i for i, s in enumerate(STATS)}
    return np.stack([stats[:, at[a]] / np.maximum(stats[:, at[b]], 1) for a, b in FEATURES.values()], axis=1) if len(stats) else np.zeros((0, len(FEATURES)))


def _fits(x: np.ndarray, tests: list[tuple[int, bool, float]]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, t in tests:
        out &= (x[:, f] > t) if above else (x[:, f] <= t)
    return out


def _grow(x: np.ndarray, bad: np.ndarray, most: int) -> list[tuple[int, bool, float]]:
    """Adds the test of most information gain until no good row is covered."""
    tests: list[tuple[int, bool, float]] = []
    mask = np.ones(len(x), bool)
    while len(tests) < most and (~bad & mask).any():
        p0, n0 = (bad & mask).sum(), (~bad & mask).sum()
        if not p0:
            break
        best, gain = None, 1e-9
        for f in range(x.shape[1]):
            values = x[mask, f]
            order = np.argsort(values, kind="stable")
            v, b = values[order], bad[mask][order]
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            p_low, n_low = np.cumsum(b)[cut], np.cumsum(~b)[cut]
            for above in (False, True):
                p, n = (p0 - p_low, n0 - n_low) if above else (p_low, n_low)
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -1.0)
                k = int(np.argmax(g))
                if g[k] > gain:
                    best, gain = (f, above, float((v[cut[k]] + v[cut[k] + 1]) / 2)), float(g[k])
        if best is None:
            break
        tests.append(best)
        mask &= _fits(x, [best])
    return tests


def _prune(x: np.ndarray, bad: np.ndarray, tests: list) -> list:
    """Drops final tests while the held-out worth (p - n) / (p + n) doesn't fall."""
    def worth(ts: list) -> float:
        m = _fits(x, ts)
        p, n = (bad & m).sum(), (~bad & m).sum()
        return (p - n) / (p + n) if p + n else -1.0

    best = tests
    for k in range(len(tests) - 1, 0, -1):
        if worth(tests[:k]) >= worth(best):
            best = tests[:k]
    return best


def learn(stats: np.ndarray, low: np.ndarray, *, max_rules: int = 12, max_tests: int = 4, least: int = 3, precision: float = 0.9) -> list[Rule]:
    """An ordered list of rejecting rules from labelled statistics (``low``: bad)."""
    x, bad = ratios(np.asarray(stats, float)), np.asarray(low, bool)
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    part = np.arange(len(x)) % 3 == 2
    names = list(FEATURES)
    while len(rules) < max_rules and (bad & left).sum() >= least:
        tests = _grow(x[left & ~part], bad[left & ~part], max_tests)
        if not tests:
            break
        tests = _prune(x[left & part], bad[left & part], tests)
        m = _fits(x, tests) & left
        exact = (bad & m).sum() / max(1, m.sum())
        if m.sum() < least or exact < precision:
            break
        rules.append(Rule(tuple(Test(names[f], a, t) for f, a, t in tests), int(m.sum()), float(exact)))
        left &= ~m
    return rules


def learn_from(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 20_000, **options) -> list[Rule]:
    """Learns from at most ``max_labelled`` labelled rows (label 0: low quality).

    The bound is the classifier's fitting sample, chosen by a hash of the id; the
    rules then judge every document.  The labels picked are at most that many
    rows of two numbers, so they are broadcast and the texts stay where they are.
    """
    picked = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(id_col).agg(F.min(label_col).alias("__label"))
        .orderBy(F.xxhash64(id_col), id_col).limit(max_labelled)
    )
    texts = df.select(F.col(id_col), F.col(text_col).alias("__t")).join(F.broadcast(picked), id_col)
    stats = statistics(texts, id_col=id_col, text_col="__t").join(F.broadcast(picked), id_col)
    rows = stats.select(id_col, "__label", *STATS).orderBy(F.xxhash64(id_col), *STATS).limit(max_labelled).toPandas()
    return learn(rows[list(STATS)].to_numpy(float), rows["__label"].to_numpy() == 0, **options)


def verdict(rules: list[Rule]) -> Column:
    """The index of the first rule that fits, else null, as one conditional expression."""
    out = None
    for i, rule in enumerate(rules):
        test = rule.tests[0].column()
        for t in rule.tests[1:]:
            test &= t.column()
        out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
    return F.lit(None).cast("int") if out is None else out.cast("int")


def judge(df: DataFrame, rules: list[Rule], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the statistics, ``base_failed, rule, kept``."""
    return (
        statistics(df, id_col=id_col, text_col=text_col)
        .withColumn("base_failed", base_failed())
        .withColumn("rule", verdict(rules))
        .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    )


def keep(df: DataFrame, rules: list[Rule], *, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that are kept, with all their columns and repeats."""
    from pyspark.sql.functions import pandas_udf

    kinds = "struct<" + ",".join(f"{s}:bigint" for s in STATS) + ">"

    @pandas_udf(kinds)
    def counted(texts):
        import pandas as pd

        return pd.DataFrame([text_stats(t or "") for t in texts], columns=list(STATS))

    own = "__quality_statistics"
    staged = df.withColumn(own, counted(F.col(text_col).cast("string")))
    tested = staged.select(*(F.col(f"`{c}`").alias(f"__in{i}") for i, c in enumerate(df.columns)), f"{own}.*")
    kept = tested.where(~base_failed() & verdict(rules).isNull())
    return kept.select(*(F.col(f"__in{i}").alias(c) for i, c in enumerate(df.columns)))
