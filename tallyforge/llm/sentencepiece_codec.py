"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

A text is read as the model reads it: one space before it, spaces as the word mark, characters the model lacks as UTF-8
byte pieces. Merges are taken from an agenda, best score first and leftmost among equals. With dropout, each candidate
that comes up is skipped for good when a hash of it, keyed by the seed, the text and the place in the text, falls under
the rate; a skipped pair can still be swallowed by a neighbouring merge. So a seed fixes a segmentation, other seeds and
texts vary it, each occurrence of a word in a text has its own, and every segmentation decodes to the same text.

The merges of a text never cross the places where no piece of the vocabulary has the two characters in a row, so a text
is cut there into short units, each encoded by itself. What can come up in a unit is a tree of courses: a course is the
candidates that come up when none of them is skipped, with the ids at its end, and each candidate leads to the course that
follows its skip. A worker keeps the courses it has met, up to a bound, and all occurrences of a batch walk the trees
together: those with a skip in their course go over to the next one, until no skip is left.

Defined results. Null text: null ids; null ids: null text. Empty text: no ids. A word mark in the text itself becomes
byte pieces, so it comes back as it was. Ids outside the vocabulary fail the decoding. Repeated rows are encoded alike.
"""

from __future__ import annotations

import heapq
import re
import string
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release

MARK = "▁"
#: Random words that place a candidate's left, middle and right end in its unit; mixed with the occurrence's key they decide.
PLACES = 4095
WORD, SPREAD = (1 << 64) - 1, 0x9E3779B97F4A7C15
LEFT, MIDDLE, RIGHT = ([xxhash.xxh3_64_intdigest(i.to_bytes(4, "little"), k) for i in range(PLACES + 1)] for k in (1, 2, 3))
_LEFT, _MIDDLE, _RIGHT = (np.array(x, np.uint64) for x in (LEFT, MIDDLE, RIGHT))
#: Courses that a worker remembers before it starts anew: about 350 bytes each.
REMEMBERED = 300_000
#: Above so many characters a unit takes the heap, below it a plain scan for the best candidate.
SHORT = 48
#: Lengths up to which short units go through the agenda together, filled up to the longest.
TOGETHER = (2, 4, 6, 8, 11, 15, 24, SHORT)
#: Texts that a worker holds as strings at once, and their characters that are encoded at once.
SLICE = 1024
AT_ONCE = 1_000_000
#: What a character is to the cut into units.
OTHER, LETTER, STOP, ALONE = 1, 2, 4, 8


@dataclass(frozen=True)
class Vocabulary:
    """Pieces in id order, their rank in merging (equal scores share one), and the ids of the 256 byte pieces."""

    pieces: tuple[str, ...]
    ranks: tuple[int, ...]
    first_byte: int
    first_piece: int

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = tuple(model.id_to_piece(i) for i in range(n))
        scores = [model.get_score(i) for i in range(n)]
        place = {s: k for k, s in enumerate(sorted(set(scores), reverse=True))}
        first_byte = pieces.index("<0x00>")
        if pieces[first_byte + 255] != "<0xFF>" or not all(re.fullmatch(f"{MARK}*[^{MARK}]*", p) for p in pieces):
            raise ValueError("a BPE model with byte pieces in a row and word marks only in front is needed")
        return cls(pieces, tuple(place[s] for s in scores), first_byte, first_byte + 256)


class Grown:
    """A NumPy array that is appended to."""

    def __init__(self, kind: type):
        self.data, self.n = np.empty(1 << 12, kind), 0

    def add(self, values) -> int:
        """Returns the place of the first."""
        at, self.n = self.n, self.n + len(values)
        while self.n > len(self.data):
            self.data = np.concatenate((self.data, np.empty_like(self.data)))
        self.data[at : self.n] = values
        return at


class Courses:
    """Courses by number: candidates (with the course that a skip leads to, -1 before it is met) and ids, each as a stretch of one array."""

    def __init__(self):
        self.candidates, self.skipped, self.ids = Grown(np.uint64), Grown(np.int32), Grown(np.int32)
        self.first, self.many, self.first_id, self.many_ids = (Grown(np.int64) for _ in range(4))
        self.of: list[tuple[str, tuple[int, ...]]] = []  # unit, and which of its candidates were skipped
        self.root: dict[str, int] = {}

    def add(self, units: list[str], skips: list[tuple[int, ...]], candidates: np.ndarray, many: np.ndarray, ids: np.ndarray, many_ids: np.ndarray) -> int:
        """Returns the number of the first; candidates and ids stand one course after another."""
        at = len(self.of)
        self.of.extend(zip(units, skips))
        self.first.add(self.candidates.add(candidates) + np.cumsum(many) - many)
        self.skipped.add(np.full(len(candidates), -1))
        self.many.add(many)
        self.first_id.add(self.ids.add(ids) + np.cumsum(many_ids) - many_ids)
        self.many_ids.add(many_ids)
        return at

    def sizes(self) -> list[int]:
        return [len(self.of), *(x.n for x in (self.candidates, self.skipped, self.ids, self.first, self.many, self.first_id, self.many_ids))]

    def forget(self, sizes: list[int]) -> None:
        """Courses that were added since these sizes, which nothing leads to."""
        del self.of[sizes[0] :]
        for x, n in zip((self.candidates, self.skipped, self.ids, self.first, self.many, self.first_id, self.many_ids), sizes[1:]):
            x.n = n


class Codec:
    """Encoder and decoder of one vocabulary, seed and rate; lives in a worker."""

    def __init__(self, vocabulary: Vocabulary, rate: float, seed: int, remembered: int = REMEMBERED):
        v = self.vocabulary = vocabulary
        self.seed, self.remembered, self.below = seed, remembered, min(int(rate * (1 << 64)), WORD)
        normal = range(v.first_piece, len(v.pieces))
        self.id_of = {v.pieces[i]: i for i in normal}
        self.none = len(v.pieces)
        self.rank_of = {v.pieces[i]: v.ranks[i] for i in normal}
        adjacent = {p[i : i + 2] for p in self.rank_of for i in range(len(p) - 1)}
        self.adjacent = adjacent
        inside = {c for pair in adjacent for c in pair}
        alone = "".join(c for c in " \n\t\r" if (MARK if c == " " else c) not in inside)
        letters, stops = self._before_stops(adjacent)
        # what a unit is; many texts are cut by the kinds of their characters to the same effect
        other = "[^ " + re.escape(alone) + "]"
        word = f" *[^\\W{re.escape(''.join(sorted(letters)))}]+(?=[{re.escape(''.join(stops))}])|" if stops else ""
        self.units = re.compile(f"{word} *{other}+| +" + (f"|[{re.escape(alone)}]" if alone else ""))
        self.kinds = self._kinds(letters, stops, alone)
        self.courses = Courses()
        # for many units at once: ids of characters, and the piece that two pieces in a row make
        self.id_of_char = np.full(0x110000, -1, np.int32)
        for piece, i in self.id_of.items():
            if len(piece) == 1:
                self.id_of_char[ord(" " if piece == MARK else piece)] = i
        self.id_of_char[ord(MARK)] = -1
        made = {}
        for piece, i in self.id_of.items():
            for k in range(1, len(piece)):
                left, right = self.id_of.get(piece[:k]), self.id_of.get(piece[k:])
                if left is not None and right is not None:
                    made[left * self.none + right] = i
        self.row, self.pairs, self.makes = self._pairs(made, self.none)
        self.rank_of_id = np.array([*v.ranks, self.none], np.int32)
        self.rank_of_id[: v.first_piece] = self.none
        bytes_of = [b""] * len(v.pieces)
        for i in normal:
            bytes_of[i] = v.pieces[i].replace(MARK, " ").encode()
        for b in range(256):
            bytes_of[v.first_byte + b] = bytes([b])
        self.bytes_of = bytes_of

    @staticmethod
    def _before_stops(adjacent: set[str]) -> tuple[set[str], list[str]]:
        """Punctuation that hardly any piece has after a letter, and the letters that one has; other letters before it are a unit apart from it."""
        before = {c: {p[0] for p in adjacent if p[1] == c and p[0].isalnum() | (p[0] == "_")} for c in string.punctuation}
        stops = [c for c, letters in before.items() if len(letters) <= 3]
        return {"_"}.union(*(before[c] for c in stops)), stops

    @staticmethod
    def _kinds(letters: set[str], stops: list[str], alone: str) -> np.ndarray:
        """For every code point: whether it is white space that is a unit by itself, or else no space; a letter that a stop is cut from; a stop."""
        kinds = np.fromiter((OTHER | LETTER * chr(i).isalnum() for i in range(0x110000)), np.uint8, 0x110000)
        kinds[[ord(c) for c in letters]] &= 0xFF - LETTER
        kinds[[ord(c) for c in stops]] |= STOP
        kinds[ord(" ")] = 0
        kinds[[ord(c) for c in alone]] = ALONE
        return kinds

    @staticmethod
    def _pairs(made: dict[int, int], none: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of left pieces laid over each other in one table without two pairs in a place: each row's start, and by place the pair and what it makes."""
        pairs = np.array(sorted(made), np.int64)
        lefts, starts = np.unique(pairs // none, return_index=True)
        rows = sorted(zip(lefts.tolist(), np.split(pairs % none, starts[1:])), key=lambda x: -len(x[1]))
        size = 4 * len(pairs) + 1
        row, held, makes = np.zeros(none + 1, np.int64), np.full(size + none + 1, -1, np.int64), np.full(size + none + 1, none, np.int32)
        place = 0
        for left, rights in rows:
            while (held[place + rights] >= 0).any():
                place = (place * 5 + 7919) % size
            row[left] = place
            held[place + rights] = left * none + rights
            makes[place + rights] = [made[x] for x in (left * none + rights).tolist()]
            place = (place * 5 + 7919) % size
        return row, held, makes

    # -- encoding

    def encode(self, text: str) -> bytes:
        """Ids as int32 in native order."""
        return self._encode([text])[1].tobytes()

    def keys(self, text: str, n: int) -> list[int]:
        """A random word for each unit of a text."""
        return self._keys([text], np.array([n])).tolist()

    def _keys(self, texts: list[str], n: np.ndarray) -> np.ndarray:
        seeds = np.array([xxhash.xxh3_64_intdigest(t.encode(), self.seed) for t in texts], np.uint64)
        place = np.arange(1, n.sum() + 1) - np.repeat(np.cumsum(n) - n, n)
        x = place.astype(np.uint64) * np.uint64(SPREAD) + np.repeat(seeds, n)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))

    def _cut(self, points: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Where units start in the code points of texts that begin at these places, each with a space before it.

        A unit is a run of other characters with the spaces before it, less what begins with a stop after nothing but letters; spaces
        that no such run follows; or one character that stands alone.
        """
        kind = self.kinds.take(points)
        other = kind & OTHER
        start = (kind == ALONE) | np.append(True, (kind[:-1] == ALONE) | (other[1:] < other[:-1]))[: len(kind)]
        start[begin] = True
        letter = np.concatenate(([0], kind & LETTER, [0]))
        edges = np.flatnonzero(letter[1:] != letter[:-1])
        first, after = edges[::2], edges[1::2]  # of runs of letters
        first, after = first[after < len(kind)], after[after < len(kind)]
        start[after[(kind[after] & STOP > 0) & (other[first - 1] == 0)]] = True  # a space is before every text
        return np.flatnonzero(start)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and all ids."""
        if len(self.courses.of) > self.remembered:
            self.courses = Courses()
        met = self.courses
        joined = "".join([" " + t for t in texts if t])
        data = joined.encode("utf-32-le")
        points = np.frombuffer(data, np.uint32)
        ends = np.cumsum(np.fromiter((len(t) + 1 if t else 0 for t in texts), np.int64, len(texts)))
        begin = np.append(0, ends[:-1])
        starts = self._cut(points, begin[begin < ends])
        n = np.diff(np.searchsorted(starts, np.append(0, ends)))
        bounds = np.append(starts, len(points))
        keys = self._keys(texts, n) if self.below else np.zeros(len(starts), np.uint64)
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(4 * bounds), pa.py_buffer(data)]).dictionary_encode()
        which = coded.indices.to_numpy()
        first = np.empty(len(coded.dictionary), np.int64)
        first[which[::-1]] = np.arange(len(which))[::-1]
        names = [joined[a:b] for a, b in zip(bounds[first].tolist(), bounds[first + 1].tolist())]
        number = np.fromiter(map(met.root.get, names, repeat(-2)), np.int64, len(names))
        long = bounds[first + 1] - bounds[first] > SHORT
        # a unit that comes up the first time, and once, takes its own draws right away, and so does a long one
        alone = (number < 0) & (long | (np.bincount(which, minlength=len(names)) == 1) & (number == -2)) & (self.below > 0)
        met.root.update((names[i], -1) for i in np.flatnonzero(alone & ~long).tolist())
        new = np.flatnonzero((number < 0) & ~alone)
        fresh = [names[i] for i in new.tolist()]
        number[new] = self._courses(fresh, [()] * len(fresh))
        met.root.update(zip(fresh, number[new].tolist()))
        end, own = number[which], alone[which]
        end[~own] = self._ends(end[~own], keys[~own])
        before = met.sizes()
        end[own] = self._courses([names[i] for i in which[own].tolist()], None, keys[own])
        many = met.many_ids.data[end]
        upto = np.cumsum(many)
        place = np.arange(upto[-1] if len(upto) else 0) + np.repeat(met.first_id.data[end] - (upto - many), many)
        ids = met.ids.data[place]
        met.forget(before)
        return np.diff(np.append(0, upto)[np.append(0, np.cumsum(n))]), ids

    def _courses(self, units: list[str], skips: list[tuple[int, ...]] | None, keys: np.ndarray | None = None) -> np.ndarray:
        """Numbers of the courses after these skips, newly met; without skips, of the courses that these keys draw to their ends."""
        if not units:
            return np.empty(0, np.int64)
        of = skips or [()] * len(units)
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        chars = self.id_of_char[np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)]
        starts = np.cumsum(lengths) - lengths
        one_by_one = (np.minimum.reduceat(chars, starts) < 0) | (lengths > SHORT)
        number = np.empty(len(units), np.int64)
        for i in np.flatnonzero(one_by_one).tolist():
            trail: list[int] = []
            ids = np.frombuffer(self.unit(units[i], 0 if keys is None else int(keys[i]), trail, skips and skips[i]), np.int32)
            left = np.array(trail if skips and self.below else [], np.uint64)[of[i][-1] + 1 if of[i] else 0 :]
            number[i] = self.courses.add([units[i]], [of[i]], left, np.array([len(left)]), ids, np.array([len(ids)]))
        upto = np.searchsorted(TOGETHER, lengths)
        for k in np.unique(upto[~one_by_one]).tolist():
            some = np.flatnonzero((upto == k) & ~one_by_one)
            at = np.arange(lengths[some].max())
            inside = at < lengths[some][:, None]
            symbols = np.where(inside, chars.take(starts[some][:, None] + at, mode="clip"), self.none)
            mine = [of[i] for i in some.tolist()]
            got = self._agendas(symbols, lengths[some], mine, None if keys is None else keys[some])
            number[some] = self.courses.add([units[i] for i in some.tolist()], mine, *got) + np.arange(len(some))
        return number

    def _agendas(self, symbols: np.ndarray, lengths: np.ndarray, skips: list[tuple[int, ...]], keys: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The agenda over many units of like lengths, a row each: candidates after the last skip, how many each has, ids, how many.

        With keys, the skips are drawn and no candidates are returned. After a unit's end its row is filled with what is in no pair.

        A symbol stands at the place of its first character; rank[u, i] is that of the pair which the symbol at i begins.
        """
        m, n = symbols.shape
        none = self.none
        base, symbol = np.arange(m) * n, symbols.ravel()
        # by row and place: the piece that the pair makes, its rank, the symbols beside
        makes, rank = np.full(m * n, none, np.int32), np.full(m * n, none, np.int32)
        after = np.tile(np.arange(1, n + 1), m)
        before = np.tile(np.arange(-1, n - 1), m)
        alive = (np.arange(n) < lengths[:, None]).ravel()

        def pair(at: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
            place = self.row.take(left) + right
            makes[at] = made = np.where(self.pairs.take(place) == left.astype(np.int64) * none + right, self.makes.take(place), none)
            rank[at] = self.rank_of_id.take(made)

        if n > 1:
            at = np.flatnonzero(after < np.repeat(lengths, n))
            pair(at, symbol[at], symbol[at + 1])
        most = 1 + max(map(len, skips))
        to_skip = np.array([s + (-1,) * (most - len(s)) for s in skips])
        skipped, came = np.zeros(m, np.int64), np.zeros(m, np.int64)
        rows, found = np.arange(m), []
        while len(rows):
            at = rank.reshape(m, n).take(rows, axis=0).argmin(axis=1)
            first = base.take(rows)
            here = first + at
            on = rank.take(here) < none
            if not on.all():
                rows, at, first, here = rows[on], at[on], first[on], here[on]
            middle = after.take(here)
            there = first + middle
            end = after.take(there)
            if self.below:
                candidate = _LEFT.take(at) ^ _MIDDLE.take(middle) ^ _RIGHT.take(end)
                if keys is not None:
                    forced = (keys.take(rows) ^ candidate) * np.uint64(SPREAD) < np.uint64(self.below)
                else:
                    turn = to_skip[rows, skipped.take(rows)]
                    forced = turn == came.take(rows)
                    found.append((rows[turn < 0], candidate[turn < 0]))
                    came[rows] += 1
                    skipped[rows] += forced
                if forced.any():
                    rank[here[forced]] = none
                    at, first, here, there, end = at[~forced], first[~forced], here[~forced], there[~forced], end[~forced]
            symbol[here] = new = makes.take(here)
            alive[there] = False
            rank[there] = rank[here] = none
            after[here] = end
            has = end < n
            beside = (first + end)[has]
            before[beside] = at[has]
            pair(here[has], new[has], symbol.take(beside))
            left = before.take(here)
            has = left >= 0
            beside = (first + left)[has]
            pair(beside, symbol.take(beside), new[has])
        alive, symbols = alive.reshape(m, n), symbol.reshape(m, n)
        who, what = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.uint64))
        return what[np.argsort(who, kind="stable")], np.bincount(who, minlength=m), symbols[alive], alive.sum(axis=1)

    def _ends(self, course: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Where the occurrences with these first courses and keys end."""
        met, rows, at = self.courses, np.arange(len(course)), course.copy()
        while len(rows):
            many = met.many.data[at[rows]]
            upto = np.cumsum(many)
            row = np.repeat(rows, many)
            place = np.arange(upto[-1]) + np.repeat(met.first.data[at[rows]] - (upto - many), many)
            hit = np.flatnonzero((keys[row] ^ met.candidates.data[place]) * np.uint64(SPREAD) < np.uint64(self.below))
            row, place = row[hit], place[hit]
            first = np.append(True, row[1:] != row[:-1])[: len(row)]
            rows, place = row[first], place[first]
            new, i = np.unique(place[met.skipped.data[place] < 0], return_index=True)
            if len(new):
                came = at[rows[met.skipped.data[place] < 0][i]]
                of = [met.of[c] for c in came]
                number = new - met.first.data[came]
                met.skipped.data[new] = self._courses([u for u, _ in of], [(*s, (s[-1] + 1 if s else 0) + k) for (_, s), k in zip(of, number.tolist())])
            at[rows] = met.skipped.data[place]
        return at

    def unit(self, unit: str, key: int, trail: list[int] | None = None, skips: tuple[int, ...] | None = None) -> bytes:
        """trail: gets the candidates in the order they come up. skips: numbers of the candidates to skip, instead of drawing them."""
        if len(unit) <= SHORT and MARK not in unit:
            part = self._scan(list(unit.replace(" ", MARK)), key, trail, skips)
        else:
            part = []
            symbols = [MARK if c == " " else f"{c}\0" if c == MARK else c for c in unit]  # a mark of the text's own matches no piece
            start = 0
            for i in range(1, len(symbols) + 1):
                if i == len(symbols) or symbols[i - 1] + symbols[i] not in self.adjacent:
                    part += self._agenda(symbols[start:i], key, start, trail, skips)
                    start = i
        ids = list(map(self.id_of.get, part))
        if None in ids:
            first = self.vocabulary.first_byte
            ids = [y for x, s in zip(ids, part) for y in ([x] if x is not None else [first + b for b in s.rstrip("\0").encode() or b"\0"])]
        return array("i", ids).tobytes()

    def _skipped(self, candidate: int, key: int, trail: list[int] | None, skips: tuple[int, ...] | None) -> bool:
        if trail is not None:
            trail.append(candidate)
        return len(trail) - 1 in skips if skips is not None else (key ^ candidate) * SPREAD & WORD < self.below

    def _scan(self, part: list[str], key: int, trail: list[int] | None = None, skips: tuple[int, ...] | None = None) -> list[str]:
        """The agenda as a list by place: its least rank, leftmost first, comes up next."""
        rank, none = self.rank_of.get, self.none
        at = list(range(len(part) + 1))
        agenda = list(map(rank, map(add, part, part[1:]), repeat(none)))
        while agenda and (best := min(agenda)) < none:
            i = agenda.index(best)
            if self.below and self._skipped(LEFT[at[i]] ^ MIDDLE[at[i + 1]] ^ RIGHT[at[i + 2]], key, trail, skips):
                agenda[i] = none
                continue
            part[i] += part.pop(i + 1)
            del at[i + 1], agenda[i]
            if i:
                agenda[i - 1] = rank(part[i - 1] + part[i], none)
            if i < len(agenda):
                agenda[i] = rank(part[i] + part[i + 1], none)
        return part

    def _agenda(self, part: list[str], key: int, offset: int, trail: list[int] | None = None, skips: tuple[int, ...] | None = None) -> list[str]:
        """The same over a heap and linked symbols, for long units."""
        n, rank, none = len(part), self.rank_of.get, self.none
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if 0 <= i and after[i] < n and (r := rank(part[i] + part[after[i]], none)) < none:
                heapq.heappush(heap, (r, i, after[i], end[after[i]]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, stop = heapq.heappop(heap)
            if part[i] == "" or after[i] != j or end[i] != j or end[j] != stop:
                continue
            if self.below and self._skipped(LEFT[offset + i & PLACES] ^ MIDDLE[offset + j & PLACES] ^ RIGHT[offset + stop & PLACES], key, trail, skips):
                continue
            part[i] += part[j]
            part[j], end[i], after[i] = "", stop, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [s for s in part if s]

    def encode_batch(self, texts: list[str | None]) -> pa.Array:
        counts, ids, a, size = [], [], 0, 0
        for b, t in enumerate(texts, 1):
            size += len(t or "")
            if size >= AT_ONCE or b == len(texts):
                n, got = self._encode([t or "" for t in texts[a:b]])
                counts.append(n)
                ids.append(got)
                a, size = b, 0
        ends = np.cumsum(np.concatenate([[0], *counts]))
        mask = pa.array([t is None for t in texts]) if None in texts else None
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *ids])), mask=mask)

    # -- decoding

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids))[1:].decode()

    def decode_batch(self, ids: pa.Array) -> pa.Array:
        return pa.array([None if x is None else self.decode(x.tolist()) for x in _lists(ids)], pa.string())


def _lists(ids: pa.Array) -> Iterator[np.ndarray | None]:
    values, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
    for i, ok in enumerate(ids.is_valid().to_pylist()):
        yield values[ends[i] : ends[i + 1]] if ok else None


class Shared:
    """A vocabulary as it is broadcast. A worker's codec hangs on it, with what it has met, and goes with it once the worker has other tasks."""

    def __init__(self, vocabulary: Vocabulary, *how):
        self.vocabulary, self.how, self.made = vocabulary, how, None

    def codec(self) -> Codec:
        if self.made is None:
            self.made = Codec(self.vocabulary, *self.how)
        return self.made


class SentencePiece:
    """Column functions over a model file, which only the driver reads."""

    def __init__(self, spark: SparkSession, model_file: str, dropout: float = 0.0, seed: int = 0):
        """dropout: rate at which candidates are skipped."""
        if not 0 <= dropout <= 1 or seed < 0:
            raise ValueError("dropout must be in [0, 1], seed not negative")
        shared = spark.sparkContext.broadcast(Shared(Vocabulary.load(model_file), dropout, seed))  # as large as the model file

        @F.arrow_udf("array<int>")
        def encode(texts: pa.Array) -> pa.Array:
            codec = shared.value.codec()
            parts = [codec.encode_batch(texts.slice(a, SLICE).to_pylist()) for a in range(0, len(texts), SLICE)]
            release()
            return pa.concat_arrays(parts) if parts else codec.encode_batch([])

        @F.arrow_udf("string")
        def decode(ids: pa.Array) -> pa.Array:
            parts = [shared.value.codec().decode_batch(ids.slice(a, SLICE)) for a in range(0, len(ids), SLICE)]
            return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

        self._encode, self._decode = encode, decode

    def encode(self, text: Column) -> Column:
        return self._encode(text)

    def decode(self, ids: Column) -> Column:
        return self._decode(ids)


def encode_documents(docs: DataFrame, codec: SentencePiece, text: str = "text") -> DataFrame:
    """docs with ids (array<int>) and decoded (string) after its own columns, which are replaced where names clash."""
    return docs.withColumn("ids", codec.encode(F.col(text))).withColumn("decoded", codec.decode(F.col("ids")))
