"""Tokenizers compiled to finite-state transducers.

Two machines, run one after the other:

* ``Pretokenizer``: a table-driven transducer over twelve states and eleven
  character classes. Its outputs mark where a pretoken begins. A text is cut in
  chunks; each chunk is first run from all states at once, which gives its state
  map (one of the few in the machine's transition monoid, so a step is one table
  look-up); a parallel prefix scan composes the maps, so every chunk knows the
  state it starts in, and one more pass emits the marks. Chunks of one long text and
  of many short ones are worked on side by side, in NumPy.
* ``MergeCounter``: a transducer over the bytes of a pretoken, determinised as
  far as the data needs. Each transition carries the number of tokens that it
  adds to (or takes from) the encoding of what has been read.

The second machine rests on a property of rank-ordered byte pair merges: the
encoding of a prefix ends in exactly one token, and that token is the one whose
pair with the last token before it survives merging on its own. So a state is
the longest suffix that begins some vocabulary entry, with the last tokens and
relative counts of the prefixes that end inside it: finitely many.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pandas as pd

LETTER, NUMBER, SPACE, BLANK, OTHER, QUOTE, STMD, RV, E, L, END = range(11)
_LETTERS = (LETTER, STMD, RV, E, L)
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, ONE_SPACE, ONE_BLANK, BLANKS_SPACE, BLANKS_BLANK, QUOTED, QUOTED_RV, QUOTED_L, CONTRACTED = range(12)
N_STATES, N_CLASSES = 12, 11
HERE, BEFORE = 1, 2  # marks: a pretoken begins at this character, at the one before


def _begin(c: int) -> int:
    if c in _LETTERS:
        return IN_LETTERS
    return {NUMBER: IN_NUMBERS, SPACE: ONE_SPACE, BLANK: ONE_BLANK, OTHER: IN_OTHERS, QUOTE: QUOTED, END: START}[c]


def _step(state: int, c: int) -> tuple[int, int]:
    """Next state and marks."""
    letters = c in _LETTERS
    if state in (QUOTED_RV, QUOTED_L):
        if c == (E if state == QUOTED_RV else L):
            return CONTRACTED, 0
        after, marks = _step(IN_LETTERS, c)
        return after, marks | BEFORE
    if c == END or state in (START, CONTRACTED):
        return _begin(c), HERE
    if c in (SPACE, BLANK) and state in (ONE_SPACE, ONE_BLANK, BLANKS_SPACE, BLANKS_BLANK):
        return (BLANKS_SPACE if c == SPACE else BLANKS_BLANK), 0
    if state in (ONE_SPACE, BLANKS_SPACE):  # a space joins what follows it
        return {NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, QUOTE: IN_OTHERS}.get(c, IN_LETTERS), BEFORE if state == BLANKS_SPACE else 0
    if state == BLANKS_BLANK:
        return _begin(c), HERE | BEFORE
    if state == QUOTED:
        if c in (STMD, RV, L):
            return {STMD: CONTRACTED, RV: QUOTED_RV, L: QUOTED_L}[c], 0
        if c in (OTHER, QUOTE):
            return IN_OTHERS, 0
    stays = {IN_LETTERS: letters, IN_NUMBERS: c == NUMBER, IN_OTHERS: c in (OTHER, QUOTE)}.get(state, False)
    return (state, 0) if stays else (_begin(c), HERE)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    for first in range(0, 0x110000, 4096):  # a piece at a time, to stay small
        some = "".join(map(chr, range(first, first + 4096)))
        for pattern, c in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", BLANK)):
            for m in regex.finditer(pattern, some):
                out[first + m.start() : first + m.end()] = c
    for letters, c in ((" ", SPACE), ("'", QUOTE), ("stmd", STMD), ("rv", RV), ("e", E), ("l", L)):
        for x in letters:
            out[ord(x)] = c
    return out


class Pretokenizer:
    """Marks pretokens of byte-level BPE; see the module's text."""

    def __init__(self, chunk: int = 256) -> None:
        steps = [[_step(s, c) for c in range(N_CLASSES)] for s in range(N_STATES)]
        self.next = np.array([[s[0] for s in row] for row in steps], np.uint8).ravel()
        self.marks = np.array([[s[1] for s in row] for row in steps], np.uint8).ravel()
        self.row = (np.arange(N_STATES) * N_CLASSES).astype(np.uint8)
        self.chunk = chunk
        self.classes = _classes()
        self._state_map_monoid()

    def _state_map_monoid(self) -> None:
        """Every state map that a chunk can have, and their products; the machine has few."""
        table = self.next.reshape(N_STATES, N_CLASSES)
        one = tuple(range(N_STATES))
        number, todo, rows = {one: 0}, [one], []
        for m in todo:
            rows.append([])
            for c in range(N_CLASSES):
                after = tuple(int(table[s, c]) for s in m)
                if after not in number:
                    number[after] = len(todo)
                    todo.append(after)
                rows[-1].append(number[after])
        self.map_next = np.array(rows, np.uint16).ravel()
        self.map_product = np.array([[number[tuple(b[s] for s in a)] for b in todo] for a in todo], np.uint16)
        self.map_from_start = np.array([m[START] for m in todo], np.uint8)

    def state_maps(self, classes: np.ndarray) -> np.ndarray:
        """classes: (chunk length, chunks). The number of each chunk's state map."""
        maps = np.zeros(classes.shape[1], np.uint16)
        for c in classes:
            maps = self.map_next[maps * np.uint16(N_CLASSES) + c]
        return maps

    def prefix_scan(self, maps: np.ndarray) -> np.ndarray:
        """Inclusive scan of the chunks' maps under composition, in log2(chunks) rounds."""
        out, reach = maps.copy(), 1
        while reach < len(out):
            out[reach:] = self.map_product[out[:-reach], out[reach:]]
            reach *= 2
        return out

    def begins(self, classes: np.ndarray) -> np.ndarray:
        """Positions where a pretoken or an END begins, of one flat array of classes."""
        n = len(classes)
        width = min(self.chunk, max(1, n))
        chunks = -(-n // width)
        padded = np.full(chunks * width, END, np.uint8)
        padded[:n] = classes
        grid = np.ascontiguousarray(padded.reshape(chunks, width).T)
        state = np.zeros(chunks, np.uint8)
        if chunks > 1:
            state[1:] = self.map_from_start[self.prefix_scan(self.state_maps(grid))[:-1]]
        marks = np.empty(grid.shape, np.uint8)
        for i, c in enumerate(grid):
            at = self.row[state] + c
            marks[i] = self.marks[at]
            state = self.next[at]
        marks = marks.T.ravel()[:n]
        here = (marks & HERE).astype(bool)
        here[:-1] |= (marks[1:] & BEFORE).astype(bool)
        return np.flatnonzero(here)


_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LONG_PRETOKEN = 256  # bytes; longer ones are told apart by their bytes, not by a hash


class Pretokens:
    """The pretokens of a batch of texts: each distinct one once, and where each stands."""

    _byte = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    _powers = _inverse = np.ones(1, np.uint64)

    def __init__(self, machine: Pretokenizer, texts: list[str]) -> None:
        joined = "\0".join(texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        classes = machine.classes[points]
        classes[ends] = END
        begins = machine.begins(classes)
        width = np.ones(len(points), np.int64)
        for least in (0x80, 0x800, 0x10000):
            width += points >= least
        offsets = np.zeros(len(points) + 1, np.int64)
        np.cumsum(width, out=offsets[1:])
        stops = np.append(begins[1:], len(points))
        real = classes[begins] != END
        begins, stops = begins[real], stops[real]
        self.text = np.searchsorted(ends, begins)  # the text each pretoken stands in
        self.n_bytes = np.diff(offsets[np.concatenate(([-1], ends)) + 1]) - 1
        self.data = joined.encode("utf-8")
        self.start, self.stop = offsets[begins], offsets[stops]
        keys = self._keys()
        self.which, self.keys = pd.factorize(keys)
        self.first = np.empty(len(self.keys), np.int64)
        self.first[self.which[::-1]] = np.arange(len(keys))[::-1]
        self.n_texts = len(texts)

    def _keys(self) -> np.ndarray:
        raw = np.frombuffer(self.data, np.uint8)
        cls = type(self)
        if len(cls._powers) <= len(raw):
            n = max(1 << 18, 2 * len(raw))
            cls._powers, cls._inverse = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, m, np.uint64)))) for m in (_ODD, _ODD_INVERSE))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self._byte[raw] * cls._powers[: len(raw)], out=sums[1:])
        keys = (sums[self.stop] - sums[self.start]) * cls._inverse[self.start]
        long = np.flatnonzero(self.stop - self.start > LONG_PRETOKEN)
        if len(long):
            import hashlib

            for i in long:
                keys[i] = int.from_bytes(hashlib.sha256(self.data[self.start[i] : self.stop[i]]).digest()[:8], "little")
        return keys

    def distinct(self, i: int) -> bytes:
        at = self.first[i]
        return self.data[self.start[at] : self.stop[at]]


@lru_cache(maxsize=1)
def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: the printable Latin-1 ones as themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _State(dict):
    """byte -> (next state, tokens emitted); the context that decides both."""

    __slots__ = ("counts", "lasts", "suffix")


class MergeCounter:
    """Counts tokens of a pretoken in one pass over its bytes, without building them."""

    MOST_STATES = 150_000  # then compiled states are let go and compiled anew as needed

    def __init__(self, path: str) -> None:
        model = json.load(open(path, encoding="utf-8"))["model"]
        of = _byte_of_char()
        raw = lambda s: bytes(of[c] for c in s)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.tokens = {raw(t) for t in model["vocab"] if all(c in of for c in t)}
        self.prefixes = {t[:i] for t in self.tokens for i in range(len(t) + 1)}
        self._fits: dict[tuple[bytes, bytes], bool] = {}
        self._clear()

    def _clear(self) -> None:
        self.states: dict[tuple, _State] = {}
        self.root = self._state(b"", (None,), (0,))

    def _state(self, suffix: bytes, lasts: tuple, counts: tuple) -> _State:
        found = self.states.get(key := (suffix, lasts, counts))
        if found is None:
            found = self.states[key] = _State()
            found.suffix, found.lasts, found.counts = suffix, lasts, counts
        return found

    def merged(self, data: bytes) -> list[bytes]:
        """Merging by rank, the definition that the machine is compiled from."""
        parts = [data[i : i + 1] for i in range(len(data))]
        none, rank = 1 << 60, self.rank.get
        ranks = [rank(x, none) for x in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), none)
        return parts

    def fits(self, a: bytes | None, b: bytes) -> bool:
        """Whether the two tokens stay apart when merged on their own."""
        if a is None:
            found = self._fits.get((b"", b))
            if found is None:
                found = self._fits[b"", b] = self.merged(b) == [b]
            return found
        found = self._fits.get((a, b))
        if found is None:
            if len(self._fits) > 1_000_000:
                self._fits.clear()
            found = self._fits[a, b] = self.merged(a + b) == [a, b]
        return found

    def _compile(self, state: _State, byte: int) -> tuple[_State, int]:
        read = state.suffix + bytes((byte,))
        suffix = read
        while suffix not in self.prefixes:
            suffix = suffix[1:]
        for n in range(len(suffix), 0, -1):
            token = suffix[-n:]
            if token in self.tokens and self.fits(state.lasts[-n], token):
                break
        count = state.counts[-n] + 1
        keep = len(suffix)
        lasts = (*state.lasts[len(state.lasts) - keep :], token)
        counts = (*(c - count for c in state.counts[len(state.counts) - keep :]), 0)
        edge = state[byte] = (self._state(suffix, lasts, counts), count)
        return edge

    def count(self, data: bytes) -> int:
        if len(self.states) > self.MOST_STATES:
            self._clear()
        state, total = self.root, 0
        for b in data:
            edge = state.get(b)
            if edge is None:
                edge = self._compile(state, b)
            state = edge[0]
            total += edge[1]
        return total
