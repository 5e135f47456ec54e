"""Toxicity by a weighted finite-state grammar over clauses.

Words are read as classes: insults (a lexicon learned from labels, and a seed),
threats, targets, negations, reports and modals.  Small transducers over classes
mark what surrounds a word: a negation, a target or a modal a few words back, a
target a few words ahead, reported speech before or after.  ``compose`` makes one
machine of those that read from the left and one of those that read from the
right; together with the word's own class their marks name the arc that is taken
at an insult or a threat, its pattern and its weight (``Grammar.clause``).  A
document's arcs are summed by pattern over its matched clauses, and a logistic
model fitted on labelled rows turns the sums into a score from 0 to 1.

The lexicon and the model are fitted on at most ``max_labelled`` labelled rows,
chosen by a hash of the id; every document is then scored over its whole text.
Only the text enters a score.

Defined results: a null or empty text matches nothing and gets the score of such
texts; repeated rows each give a row; an empty table gives an empty result; other
columns are neither read nor returned; a null id stays null and is not held out.
Without labels of both classes the seed lexicon and fixed weights are used.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.llm.columns import map_texts

#: Fixed word lists of the classes.
SEED_INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "imbecile")
THREATS = ("kill", "hurt", "destroy", "murder", "attack", "stab", "shoot", "burn", "beat")
TARGETS = ("you", "your", "yours", "he", "she", "they", "him", "her", "them", "people", "u", "tu", "vous", "du", "ihr", "usted")
NEGATIONS = ("not", "no", "never", "without", "hardly", "isn", "aren", "wasn", "don", "didn", "pas", "jamais", "nicht", "kein", "nunca")
REPORTS = ("said", "says", "wrote", "claimed", "reported", "according", "quoted", "called", "alleged")
MODALS = ("will", "ll", "gonna", "going", "shall", "should", "must", "werde", "vais", "voy")
#: Classes of words; a word is of the first list that holds it.
OTHER, INSULT, THREAT, NEGATION, TARGET, REPORT, MODAL = range(7)
#: Patterns that the arcs of the grammar belong to.
PATTERNS = ("insult", "insult_target", "insult_negated", "insult_reported", "threat", "threat_target", "clauses")
_CLAUSE = re.compile(r"[.!?;\n]+")
_WORD = re.compile(r"[^\W\d_]+")
#: How many words a negation reaches ahead, a modal ahead, a target both ways.
NEGATED, MEANT, AIMED = 3, 3, 4
#: Length of the word beginnings that the lexicon also holds.
STEM = 4


class Machine(NamedTuple):
    """A deterministic transducer over classes; state 0 is the start.

    ``moves[state][class]`` is the next state, ``marks[state]`` what it says of
    the word that is read next.
    """

    moves: tuple[tuple[int, ...], ...]
    marks: tuple[tuple[bool, ...], ...]


def reaching(kind: int, words: int) -> Machine:
    """Marks the ``words`` words that follow one of the class: states count down from it."""
    return Machine(tuple(tuple(words if c == kind else max(0, state - 1) for c in range(7)) for state in range(words + 1)), tuple((state > 0,) for state in range(words + 1)))


def lasting(kind: int) -> Machine:
    """Marks all words that follow one of the class."""
    return Machine(tuple(tuple(int(state or c == kind) for c in range(7)) for state in (0, 1)), ((False,), (True,)))


def compose(*machines: Machine) -> Machine:
    """One machine that runs all of them at once: the reachable states of their product."""
    start = (0,) * len(machines)
    states, moves = {start: 0}, []
    order = [start]
    for now in order:
        row = []
        for c in range(7):
            after = tuple(m.moves[s][c] for m, s in zip(machines, now))
            if after not in states:
                states[after] = len(order)
                order.append(after)
            row.append(states[after])
        moves.append(tuple(row))
    return Machine(tuple(moves), tuple(tuple(x for m, s in zip(machines, now) for x in m.marks[s]) for now in order))


#: Read from the left: negation, target, report, modal; from the right: target, report.
BEFORE = compose(reaching(NEGATION, NEGATED), reaching(TARGET, AIMED), lasting(REPORT), reaching(MODAL, MEANT))
AFTER = compose(reaching(TARGET, AIMED), lasting(REPORT))


def arc(kind: int, before: tuple[bool, ...], after: tuple[bool, ...]) -> tuple[str, float]:
    """The pattern of an insult or threat among these marks, and the arc's weight."""
    negated, aimed, reported, meant = before
    aimed, reported = aimed or after[0], reported or after[1]
    if kind == INSULT:
        return "insult_negated" if negated else "insult_reported" if reported else "insult_target" if aimed else "insult", 1.0
    if aimed and not negated and not reported:
        return "threat_target", 1.5 if meant else 1.0
    return "threat", 0.2


#: The composed grammar's arcs: pattern and weight by class, state from the left and state from the right.
ARCS = {kind: tuple(tuple(arc(kind, b, a) for a in AFTER.marks) for b in BEFORE.marks) for kind in (INSULT, THREAT)}


@dataclass(frozen=True)
class Grammar:
    """The learned lexicon (words and word beginnings with weights) and the model's weights."""

    words: dict[str, float]
    stems: dict[str, float]
    bias: float
    weights: tuple[float, ...]

    def weight(self, word: str) -> float:
        return self.words.get(word) or (self.stems.get(word[:STEM], 0.0) if len(word) > STEM else 0.0)

    def kind(self, word: str) -> int:
        return INSULT if self.weight(word) else _CLASS.get(word, OTHER)

    def clause(self, words: list[str]) -> dict[str, float]:
        """Sums of the weights of the arcs taken on one clause, by pattern."""
        kinds = [self.kind(w) for w in words]
        behind, state = [0] * len(words), 0
        for i in range(len(words) - 1, -1, -1):
            behind[i] = state
            state = AFTER.moves[state][kinds[i]]
        out: dict[str, float] = {}
        state = 0
        for word, kind, right in zip(words, kinds, behind):
            if kind in ARCS:
                pattern, weight = ARCS[kind][state][right]
                out[pattern] = out.get(pattern, 0.0) + weight * (self.weight(word) if kind == INSULT else 1.0)
            state = BEFORE.moves[state][kind]
        return out

    def features(self, text: str) -> list[float]:
        """Pattern sums of a whole text, each by log(1 + sum)."""
        low = text.lower()
        words = set(_WORD.findall(low))
        sums = dict.fromkeys(PATTERNS, 0.0)
        if not (self.words.keys().isdisjoint(words) and _THREATS.isdisjoint(words)) or any(w[:STEM] in self.stems and len(w) > STEM for w in words):
            for clause in _CLAUSE.split(low):
                if found := self.clause(_WORD.findall(clause)):
                    for kind, weight in found.items():
                        sums[kind] += weight
                    sums["clauses"] += not found.keys() <= {"threat"}
        return [math.log1p(sums[p]) for p in PATTERNS]

    def score(self, text: str) -> float:
        z = self.bias + sum(w * x for w, x in zip(self.weights, self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


_CLASS = {w: kind for kind, words in ((MODAL, MODALS), (REPORT, REPORTS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (THREAT, THREATS)) for w in words}
_THREATS = frozenset(THREATS)
DEFAULT = Grammar({w: 1.0 for w in SEED_INSULTS}, {}, -3.0, (3.0, 3.5, 0.5, 1.0, 0.0, 3.0, 0.5))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def lexicon(labelled: DataFrame, *, least: int, precision: float, size: int) -> tuple[dict, dict]:
    """Words and stems that mark label 1: by counts of documents over ``labelled`` (``id, text, label``)."""

    def make():
        def apply(texts):
            found = []
            for text in texts:
                words = set(_WORD.findall(text.lower()))
                found.append([*words, *{f"{w[:STEM]}*" for w in words if len(w) > STEM}])
            return [found]

        return apply

    tokens = map_texts(labelled.select(F.struct("id", "label").alias("key"), "text"), make, "tokens array<string>", "key", "text")
    counts = (
        tokens.select(F.col("key.label").alias("label"), F.explode("tokens").alias("token"))
        .groupBy("token").agg(F.sum("label").alias("pos"), F.count("*").alias("n"))
        .where((F.col("pos") >= least) & (F.col("pos") >= precision * F.col("n")))
        .orderBy(F.desc("pos"), "token").limit(size).collect()
    )
    weigh = {r["token"]: min(3.0, math.log((r["pos"] + 0.5) / (r["n"] - r["pos"] + 0.5)) / 2) for r in counts}
    return {t: w for t, w in weigh.items() if t[-1] != "*"}, {t[:-1]: w for t, w in weigh.items() if t[-1] == "*"}


def fit(x: np.ndarray, y: np.ndarray, *, ridge: float = 1.0, steps: int = 50) -> tuple[float, tuple[float, ...]]:
    """Logistic regression by Newton's method with a ridge on the weights."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    penalty = np.diag([1e-6, *[ridge] * x.shape[1]])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), tuple(map(float, w[1:]))


def learn(
    df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_labelled: int = 20_000, precision: float = 0.85, share: float = 0.01, size: int = 400,
) -> Grammar:
    """A grammar from the labelled rows that are not held out.

    The labels picked are at most ``max_labelled`` rows of two numbers, so they
    are broadcast and the texts stay where they are.
    Words that at least ``share`` of the positive rows hold, with at least this
    ``precision`` (more where most labels are positive), enter the lexicon (at
    most ``size``).  The model is fitted on at most twice as many rows (ids may
    repeat), chosen by a hash of the row.
    """
    picked = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(~held_out(id_col))
        .groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    )
    labelled = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "id")
    n, pos = labelled.agg(F.count("*"), F.sum("label")).first()
    if not n or not 0 < pos < n:
        return DEFAULT
    words, stems = lexicon(labelled, least=max(4, math.ceil(share * pos)), precision=max(precision, (1 + pos / n) / 2), size=size)
    grammar = Grammar({**{w: 1.0 for w in SEED_INSULTS}, **words}, stems, 0.0, (0.0,) * len(PATTERNS))
    rows = map_texts(
        labelled.select(F.struct("id", "label").alias("key"), "text"), lambda: lambda texts: [[grammar.features(t) for t in texts]], "x array<double>", "key", "text"
    ).select("key.id", "key.label", "x").orderBy(F.xxhash64("id", "label", "x"), "id", "label").limit(2 * max_labelled).collect()
    rows.sort(key=lambda r: (r["id"], r["label"], r["x"]))
    bias, weights = fit(np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows], float))
    return Grammar(grammar.words, stems, bias, weights)


def score(df: DataFrame, grammar: Grammar, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``id_col, held_out, score, predicted`` of every row."""
    scored = map_texts(df, lambda: lambda texts: [[grammar.score(t) for t in texts]], "score double", id_col, text_col)
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
