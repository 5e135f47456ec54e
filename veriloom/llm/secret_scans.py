"""Secret scans: fixed patterns, and guess-cost scoring of credential values.

Fixed patterns give *assign*, *access* and *hex* spans (leftmost matches of each
kind that do not overlap; a match that fails its length is dropped).  On top, a
value that stands in a credential context ("passphrase: ...", "pwd is ...") is
scored by dynamic programming: the cheapest segmentation into words, dates,
repeats, keyboard walks and brute-force spans, in powers of ten of guesses.
Values at or over ``min_guesses`` become *guess* spans unless a fixed span
already covers them.

Words are ranked: first a fixed list that guessers start with, then the corpus's
own words by the number of documents that hold them (``ranked_words``, over all
documents).  A word is also found inside a run of letters and behind the usual
substitutions of digits and signs for letters.

Defined results: a null or empty text has no spans; spans count code points, end
exclusive; repeated rows each give a row; an empty table gives an empty result;
other columns are neither read nor returned by ``scan``; a null id stays null;
without texts there are no ranked words.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator, Mapping
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.columns import drop_table, map_texts, shared_table

KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_CUES = ("pass", "pwd", "secret", "token", "credential", "key", "bearer", "auth", "login")
#: A name that holds a cue, and what leads to its value (an authorization scheme too).  A name is matched from its start, once, so the work stays linear.
_CONTEXT = re.compile(
    r"""(?ai:(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?(?:(?:api|access|private|secret|auth)[ _-]?key|pass(?:word|wd|phrase|code)|pwd|secret|token|credentials?|bearer|auth(?:orization)?(?![A-Za-z])|login)[A-Za-z0-9_-]*))["']?"""
    r"""\s{0,4}(?:[:=]|=>|->|\b(?:is|was)\b|(?ai:(?<=bearer)))\s{0,4}["'`]?(?ai:(?:bearer|basic|digest|token|negotiate|apikey)\s{1,4}["'`]?)?(?=[^\s"'`<>]{6})"""
)
_VALUE = re.compile(r"""[^\s"'`<>]+""")
_DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")
_WORD = re.compile(r"[^\W\d_]{3,}")
_REPEAT = re.compile(r"(.{1,16}?)\1+", re.S)
_VOWEL = re.compile(r"[aeiouyà-ÿ]", re.I)
#: Rows of a keyboard, and words that guessers try first.
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
COMMON = ("password", "letmein", "welcome", "admin", "secret", "dragon", "monkey", "master", "login", "test", "example", "changeme", "none", "null", "true", "false", "token", "default", "your", "here", "value")
_WALKS = {a + b for row in (*ROWS, "abcdefghijklmnopqrstuvwxyz", "0123456789") for a, b in zip(row, row[1:])}
_WALKS |= {w[::-1] for w in _WALKS}


#: Signs that stand for letters.
FOLDED = str.maketrans("013457@$!", "oieastasi")
#: Ranks of the fixed words.
BASE = {w: i + 1 for i, w in enumerate(COMMON)}
_LONGEST = 16


def ranks(words: Iterable[str]) -> dict[str, int]:
    """Words with their ranks: the fixed list, then ``words``."""
    out = dict(BASE)
    for word in words:
        out.setdefault(word, len(out) + 1)
    return out


def ranked_words(df: DataFrame, *, text_col: str = "text", size: int = 20_000, least: int = 4) -> list[str]:
    """The corpus's ``size`` most common words of ``least`` to 16 letters (lower case), by documents that hold them.

    Counts cover all documents; what comes to the driver, and goes back to the
    executors with the function, is the list alone, bounded by ``size``.  The count at
    which the list ends is found from a histogram (of some hundred steps), so that
    tasks don't each send their ``size`` best.
    """
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.col(f"`{text_col}`").cast("string")), F.lit(rf"(?<!\p{{L}})\p{{L}}{{{least},{_LONGEST}}}(?!\p{{L}})"), F.lit(0)))
    counts = df.select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where("n > 1")
    kept = shared_table(counts.withColumn("step", F.floor(16 * F.log2("n")).cast("int")))
    last, left = -1, size
    for step, n in sorted(kept.groupBy("step").agg(F.count("*").alias("n")).collect(), reverse=True):
        if n > left:
            last = step
            break
        left -= n
    rows = kept.where(F.col("step") > last).collect() + kept.where(F.col("step") == last).orderBy(F.desc("n"), "word").limit(left).collect()
    drop_table(kept)
    return [r["word"] for r in sorted(rows, key=lambda r: (-r["n"], r["word"]))]


def _lowered(value: str) -> str:
    """Lower case, character by character (a letter with a longer lower case stays)."""
    low = value.lower()
    return low if len(low) == len(value) else "".join(c.lower() if len(c.lower()) == 1 else c for c in value)


def _word_spans(value: str, low: str, rank: Mapping[str, int]) -> Iterator[tuple[int, int, float]]:
    """Spans of ranked words and of runs of letters that read like words, with their costs."""
    folded = low.translate(FOLDED)
    case = lambda part: 0.0 if part == part.lower() or part == part.upper() or part == part.title() else 0.5 * sum(c.isupper() for c in part)
    for m in _WORD.finditer(folded):
        for a in range(m.start(), m.end() - 2):
            for b in range(a + 3, min(a + _LONGEST, m.end()) + 1):
                if place := rank.get(folded[a:b]):
                    signs = sum(x != y for x, y in zip(low[a:b], folded[a:b]))
                    yield a, b, max(1.0, math.log10(place)) + 0.5 + 0.5 * signs + case(value[a:b])
    for m in _WORD.finditer(low):
        word = m[0]
        if len(_VOWEL.findall(word)) * 5 >= len(word) and not re.search(r"[^aeiouyà-ÿ]{5}", word):
            yield m.start(), m.end(), 3.0 + 0.25 * len(word) + case(value[m.start() : m.end()])


def guess_cost(value: str, rank: Mapping[str, int] = BASE) -> float:
    """log10 of the guesses that the cheapest segmentation of ``value`` needs.

    Spans: ranked words (their rank), word-like letter runs (thousands, with a
    vowel), dates (four powers), repeats (their unit's cost and the count),
    keyboard walks of four keys or more, and brute force by character class.
    Each further span costs a factor of ten.  The work is in proportion to the
    value's length.
    """
    n, low = len(value), _lowered(value)
    spans = list(_word_spans(value, low, rank))
    spans += [(*m.span(), 4.0) for m in _DATE.finditer(value)]
    for m in _REPEAT.finditer(value):
        if len(m[0]) >= max(6, 3 * min(len(m[1]), 2)):
            spans.append((*m.span(), guess_cost(m[1], rank) + math.log10(len(m[0]) / len(m[1]))))
    start = 0
    for i in range(1, n + 1):
        if i == n or low[i - 1 : i + 1] not in _WALKS:
            if i - start >= 4:
                spans.append((start, i, 2.0 + math.log10(i - start)))
            start = i
    ends: dict[int, list[tuple[int, float]]] = {}
    for a, b, cost in spans:
        ends.setdefault(b, []).append((a, cost))
    best = [0.0] + [math.inf] * n
    brute = [False] * (n + 1)
    for i in range(1, n + 1):
        c = value[i - 1]
        each = 1.0 if c.isdigit() else 1.42 if c.islower() else 1.42 if c.isupper() else 1.5
        best[i], brute[i] = best[i - 1] + each + (0.0 if brute[i - 1] or i == 1 else 1.0), True
        for a, cost in ends.get(i, ()):
            if (total := best[a] + cost + (1.0 if a else 0.0)) < best[i]:
                best[i], brute[i] = total, False
    return best[n]


def fixed_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start, then kind as listed."""
    found = []
    if "=" in text or ":" in text:
        found += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def guess_spans(text: str, fixed: list[tuple[int, int, str]], min_guesses: float, rank: Mapping[str, int] = BASE) -> list[tuple[int, int, str]]:
    """Values in credential contexts that cost ``min_guesses`` powers of ten or more."""
    low = text.lower()
    if not any(cue in low for cue in _CUES):
        return []
    found, at, run, end = [], 0, 0, 0
    starts = [s for s, _, _ in fixed]
    reach = list(accumulate((e for _, e, _ in fixed), max))
    while m := _CONTEXT.search(text, at):
        a = at = m.end()
        if a >= run:  # else a value in a run of characters that was looked at before
            run = _VALUE.match(text, a).end()
            end = a + len(text[a:run].rstrip(".,;:!?)]}"))
        before = bisect_right(starts, a)
        if end - a < 6 or (before and reach[before - 1] >= end):
            continue
        value = text[a:end]
        if guess_cost(value, rank) >= min_guesses:
            found.append((a, end, "guess"))
            at = run
    return found


def find(text: str, min_guesses: float = 8.0, rank: Mapping[str, int] = BASE) -> tuple[list, list]:
    """(fixed spans, all spans), each sorted."""
    fixed = fixed_spans(text)
    more = guess_spans(text, fixed, min_guesses, rank)
    return fixed, sorted(fixed + more, key=lambda s: (s[0], KINDS.index(s[2]), s[1])) if more else fixed


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def _mapped(df: DataFrame, one: Callable[[str], tuple], schema: str, id_col: str, text_col: str) -> DataFrame:
    return map_texts(df, lambda: lambda texts: list(map(list, zip(*map(one, texts)))), schema, id_col, text_col)


def scan(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_guesses: float = 8.0, words: Iterable[str] = ()) -> DataFrame:
    """``id_col, n_assign, n_access, n_hex, n_guess, base_sha256, spans`` of every row; ``words``: ranked words."""
    rank = ranks(words)

    def one(text: str) -> tuple:
        fixed, spans = find(text, min_guesses, rank)
        kinds = [k for _, _, k in spans]
        return (*(kinds.count(k) for k in KINDS), hashlib.sha256(joined(fixed).encode()).hexdigest(), joined(spans))

    return _mapped(df, one, "n_assign bigint, n_access bigint, n_hex bigint, n_guess bigint, base_sha256 string, spans string", id_col, text_col)


def redact(text: str, mask: str, min_guesses: float, rank: Mapping[str, int] = BASE) -> str:
    out, at = [], 0
    for a, b, _ in find(text, min_guesses, rank)[1]:
        if b > at:
            out += [text[at : max(a, at)], mask if a >= at else ""]
            at = b
    return "".join(out) + text[at:]


def redacted(df: DataFrame, *, text_col: str = "text", mask: str = "[secret]", min_guesses: float = 8.0, words: Iterable[str] = ()) -> DataFrame:
    """``df`` with every span in ``text_col`` replaced by ``mask``; null stays null; all columns stay."""
    from pyspark.sql.functions import pandas_udf

    rank = ranks(words)

    @pandas_udf("string")
    def masked(texts):
        return texts.map(lambda t: None if t is None else redact(t, mask, min_guesses, rank))

    return df.withColumn(text_col, masked(F.col(f"`{text_col}`").cast("string")))
