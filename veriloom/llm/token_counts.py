"""Token counts by a compiled finite-state transducer.

The vocabulary of a piece model is compiled into a deterministic transducer.  Its
states are pieces: after any prefix, the state is the last piece of that prefix's
encoding.  Merging by rank makes that piece unique: of the pieces that end at a
character, exactly one may follow the state before it, where one piece may follow
another if merging their joined text gives those two again.  So a transition
reads a piece's characters, goes to that piece, and is annotated with one emitted
token; a character outside the vocabulary is annotated with its bytes.  Which
pieces may follow which is worked out when first met and kept.

A boundary between two characters is *free* when no piece spans it; the compiler
proves this from the vocabulary for every boundary it uses (before a word mark
that follows another character, and around a line feed).  At a free boundary the
state is the start again, so what lies between two of them, a segment, always
emits the same number of tokens, and the transducer's run over a segment is kept
as one transition in a bounded table.

Chunks of a long text become state maps ``(head, count, tail)``: what must still
be joined to the left, what has been emitted, what must be joined to the right.
Maps compose associatively, so chunks are mapped apart and combined by a
parallel prefix scan, however the text was cut.

Defined results: a null or empty text has 0 tokens and 0 bytes; repeated rows
are counted each; an empty table gives an empty result; other columns, whatever
their names, are neither read nor returned; a null id stays null.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.columns import map_texts

#: The mark that piece models put for a space.
MARK = "▁"


class StateMap(NamedTuple):
    """What a chunk does to the state at its start.

    ``count`` is None while the chunk has no free boundary; all of it is then in
    ``head``.
    """

    head: str
    count: int | None
    tail: str


class Transducer:
    """The compiled transducer of one piece model.

    ``limit`` bounds the transitions kept; past it the table starts anew, which
    changes no result.
    """

    chunk_chars = 1 << 16
    _segment = re.compile(r"\n[^ \n]*| +[^ \n]*")
    _boundary = re.compile(r"\n|(?<=[^ ]) ")

    def __init__(self, model_path: str, limit: int = 400_000) -> None:
        import sentencepiece

        self._pieces = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self._prove_boundaries()
        self._states = PieceStates(self._pieces)
        self._table = _Transitions(self._annotate, limit)

    def _prove_boundaries(self) -> None:
        sp = self._pieces
        for i in range(sp.piece_size()):
            piece = sp.id_to_piece(i)
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) and ("\n" in piece or MARK in piece.lstrip(MARK)):
                raise ValueError(f"piece {i} spans a boundary that the transducer takes to be free")

    def _annotate(self, segment: str) -> int:
        """Tokens that the transducer emits on a segment.

        A segment that starts with a line feed follows no mark.  Runs of marks
        are the only pieces of equal rank, where merging isn't a matter of rank
        alone; segments with such runs are annotated by the model itself.
        """
        if segment[:1] == " ":
            return len(self._pieces.encode(segment))
        return self._states.emitted(segment if segment[:1] == "\n" else MARK + segment)

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        text = text.replace(MARK, " ")
        if len(text) <= self.chunk_chars:
            return self._run(" " + text)
        chunks = [text[i : i + self.chunk_chars] for i in range(0, len(text), self.chunk_chars)]
        chunks[0] = " " + chunks[0]
        last = self.scan([self.chunk_map(c) for c in chunks])[-1]
        if last.count is None:
            return self._run(last.head)
        return self._run(last.head) + last.count + self._run(last.tail)

    def _run(self, text: str) -> int:
        """Tokens of text that starts at a free boundary, with its space or line feed."""
        if text[:1] == " ":
            spaced = text[1:].replace("\n", " \n")
            if spaced and "  " not in spaced and spaced[0] != " " and spaced[-1] != " ":
                return sum(map(self._table.__getitem__, spaced.split(" ")))
        return sum(self._table[s[1:] if s[0] == " " else s] for s in self._segment.findall(text))

    def chunk_map(self, chunk: str) -> StateMap:
        """The state map of a chunk cut anywhere."""
        first = self._boundary.search(chunk)
        if first is None:
            return StateMap(chunk, None, "")
        end = self._last(chunk, first.start())
        return StateMap(chunk[: first.start()], self._run(chunk[first.start() : end]), chunk[end:])

    def _last(self, chunk: str, least: int) -> int:
        """Where the last free boundary of a chunk lies; ``least`` is one."""
        feed, space = chunk.rfind("\n"), chunk.rfind(" ")
        while space > least and chunk[space - 1] == " ":
            space -= 1
        return max(feed, space, least) if space > least else max(feed, least)

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        """First ``a``, then ``b``.  Associative."""
        if a.count is None:
            if b.count is None:
                return self._settle(StateMap(a.head + b.head, None, ""), len(a.head))
            return self._front(a.head + b.head, len(a.head), b)
        if b.count is None:
            tail = self.chunk_map_at(a.tail + b.head, len(a.tail))
            return StateMap(a.head, a.count + tail[0], tail[1])
        middle = self.chunk_map_at(a.tail + b.head, len(a.tail))
        return StateMap(a.head, a.count + middle[0] + self._run(middle[1]) + b.count, b.tail)

    def chunk_map_at(self, text: str, seam: int) -> tuple[int, str]:
        """Text that starts at a free boundary and may have one more at a seam."""
        if 0 < seam < len(text) and text[seam] == " " and text[seam - 1] != " ":
            return self._run(text[:seam]), text[seam:]
        return 0, text

    def _settle(self, joined: StateMap, seam: int) -> StateMap:
        text = joined.head
        if 0 < seam < len(text) and text[seam] == " " and text[seam - 1] != " ":
            return StateMap(text[:seam], 0, text[seam:])
        return joined

    def _front(self, head: str, seam: int, b: StateMap) -> StateMap:
        if 0 < seam < len(head) and head[seam] == " " and head[seam - 1] != " ":
            return StateMap(head[:seam], self._run(head[seam:]) + b.count, b.tail)
        return StateMap(head, b.count, b.tail)

    def scan(self, maps: list[StateMap]) -> list[StateMap]:
        """All prefixes' compositions, by doubling strides (each stride's are independent)."""
        maps, stride = list(maps), 1
        if len(maps) > 64:  # only the last prefix is ever asked for: a tree gives it with less text moved
            while len(maps) > 1:
                maps = [reduce(self.compose, maps[i : i + 2]) for i in range(0, len(maps), 2)]
            return maps
        while stride < len(maps):
            maps = [maps[i] if i < stride else self.compose(maps[i - stride], maps[i]) for i in range(len(maps))]
            stride *= 2
        return maps


class PieceStates:
    """The transducer over characters: which piece may follow which, and what it emits."""

    def __init__(self, pieces, limit: int = 600_000) -> None:
        kept = [i for i in range(pieces.piece_size()) if not (pieces.is_control(i) or pieces.is_unknown(i) or pieces.is_byte(i) or pieces.is_unused(i))]
        self._rank = {pieces.id_to_piece(i): -pieces.get_score(i) for i in kept}
        self._names = ["", *self._rank]  # state 0 is the start
        self._state = {piece: i for i, piece in enumerate(self._names) if i}
        self._longest = max(map(len, self._rank))
        self._follows: dict[int, bool] = {}
        self._limit = limit

    def _merged(self, text: str) -> list[str]:
        """A short text's pieces, by merging the best-ranked pair, the first of equals."""
        parts, rank = list(text), self._rank
        while len(parts) > 1:
            best, at = min((rank.get(a + b, float("inf")), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == float("inf"):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _may_follow(self, before: int, after: int) -> bool:
        """Whether a piece may follow the state before it."""
        first, second = self._names[before], self._names[after]
        found = self._merged(first + second) == ([first, second] if first else [second])
        if len(self._follows) >= self._limit:
            self._follows.clear()
        self._follows[before << 20 | after] = found
        return found

    def emitted(self, text: str) -> int:
        """Tokens emitted from the start state on a text without runs of marks."""
        state, follows, longest = self._state, self._follows, self._longest
        states, counts = [0], [0]
        total = 0
        for i in range(1, len(text) + 1):
            here = len(states)  # one more than the characters since the last start
            for n in range(1, min(longest, here) + 1):
                piece = state.get(text[i - n : i])
                if piece is not None:
                    before = states[-n]
                    fits = follows.get(before << 20 | piece)
                    if fits is None:
                        fits = self._may_follow(before, piece)
                    if fits:
                        states.append(piece)
                        counts.append(counts[-n] + 1)
                        break
            else:
                if text[i - 1] in state:
                    raise AssertionError(f"no piece ends at {i} of {text!r}")
                total += counts[-1] + len(text[i - 1].encode())
                states, counts = [0], [0]
        return total + counts[-1]


class _Transitions(dict):
    def __init__(self, annotate, limit: int) -> None:
        super().__init__()
        self._annotate, self._limit = annotate, limit

    def __missing__(self, segment: str) -> int:
        emitted = self._annotate(segment)
        if len(segment) <= 64:
            if len(self) >= self._limit:
                self.clear()
            self[segment] = emitted
        return emitted


_compiled: dict[tuple[str, int], Transducer] = {}


def transducer(model_path: str, limit: int = 400_000) -> Transducer:
    """The transducer of a model file, compiled once a process."""
    if (model_path, limit) not in _compiled:
        _compiled[model_path, limit] = Transducer(model_path, limit)
    return _compiled[model_path, limit]


def token_counts(
    df: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", token_limit: int = 4096, transitions: int = 400_000
) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` for every row of ``df``.

    ``model_path`` names a file that every executor has (a vocabulary installed
    with the Python environment).
    """

    def make():
        t = transducer(model_path, transitions)
        return lambda texts: [[len(x.encode()) for x in texts], [t.count(x) for x in texts]]

    return map_texts(df, make, "n_bytes bigint, n_tokens bigint", id_col, text_col).withColumn("over_limit", F.col("n_tokens") > token_limit)
