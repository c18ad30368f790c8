"""Language identification by cross-parsing entropy.

Per language, a suffix automaton is built of labelled text. A text is parsed against each: the longest piece that occurs
in the language's text is one phrase, then parsing starts afresh. Related text is cut into few long phrases, so the
language with the fewest phrases, normalised to bits per letter by the size of its text (phrases * log2(size) / letters),
wins. Texts are parsed whole. Stretches of them advance through the automata together, each as if a phrase began there; then each
is entered anew in the state that its predecessor ended in, until the two ways meet, which they do within a few phrases,
and so on from stretches where they don't. The phrases are those of one parse from the text's beginning to its end.

Fitting takes a bounded sample: of each language ``sample_docs`` distinct labelled texts, the first by hash, so neither
the order of rows nor copies matter, and of each a stretch of ``sample_chars`` characters from a hashed place in it, so
that shared openings don't stand for the language: 128 * 240 = 30,720 characters a language. Where a language has fewer
texts, each gives more stretches, or the whole of it if that is no longer. Beyond 128 languages each gets a smaller
share of the same total. Everything else covers all rows.

Defined results. Null text, or one without a letter: ``und``, score 0. No labelled language at all: ``und``, score 0, for
every row. Ties: the language that sorts first. Null lang or id: not learned from. Repeated rows: predicted alike. Empty
table: no rows. Letters no language has end a phrase and count as one each.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import release

UNKNOWN = "und"
#: Characters of a stretch; languages with a full sample (beyond, samples shrink, so tables stay bounded).
STRETCH, MOST_LANGUAGES = 256, 128
#: Characters that are looked up at once.
AT_ONCE = 500_000
#: Texts that a worker holds as strings at once.
SLICE = 256
#: How sharply a difference in bits per letter turns into confidence.
SHARPNESS = 6.0


@dataclass(frozen=True)
class Sample:
    sample_docs: int = 128
    sample_chars: int = 240


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a symbol sequence; state 0 is the start."""
    arcs, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        new, p = len(arcs), last
        arcs.append({}), link.append(0), length.append(length[last] + 1)
        while p >= 0 and c not in arcs[p]:
            arcs[p][c] = new
            p = link[p]
        if p >= 0:
            q = arcs[p][c]
            if length[q] != length[p] + 1:
                twin = len(arcs)
                arcs.append(dict(arcs[q])), link.append(link[q]), length.append(length[p] + 1)
                while p >= 0 and arcs[p].get(c) == q:
                    arcs[p][c] = twin
                    p = link[p]
                link[q] = twin
                q = twin
            link[new] = q
        last = new
    return arcs


class CrossParser:
    """Fitted automata, as tables that step many texts at once."""

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(texts)
        folded = {k: ["".join(c if c.isalpha() else " " for c in t.lower()) for t in v] for k, v in texts.items()}
        letters = sorted({c for v in folded.values() for t in v for c in t} - {" "})
        self.letters = "".join(letters)
        self.width = len(letters) + 2  # a space or anything else is 0, letters follow, the last is a letter unseen in fitting
        of = {c: i + 1 for i, c in enumerate(letters)} | {" ": 0}
        self.sizes, self.tables, self.narrow = [], [], []
        for k in self.languages:
            symbols = [of[c] for c in " ".join(" ".join(folded[k]).split())]
            own = sorted(set(symbols) - {0})  # a language's table has columns for its own letters only
            narrow = np.full(self.width, len(own) + 1, np.int32)
            narrow[[0, *own]] = np.arange(len(own) + 1)
            self.narrow.append(narrow)
            self.sizes.append(max(2, len(symbols)))
            self.tables.append(self._table(suffix_automaton(narrow[symbols].tolist()), len(own) + 2))

    @staticmethod
    def _table(arcs: list[dict[int, int]], width: int) -> np.ndarray:
        """Per state and symbol: four times the place of the next state's row, plus the phrases that end there.

        Where a state lacks the symbol its phrase ends and the symbol starts the next; one that even the start lacks is a
        phrase by itself.
        """
        start = np.ones(width, np.int32 if len(arcs) * width < 1 << 29 else np.int64)
        for c, to in arcs[0].items():
            start[c] = to * width * 4
        table = np.tile(start + 1, (len(arcs), 1))
        table[0] = start
        for state, out in enumerate(arcs):
            for c, to in out.items():
                table[state, c] = to * width * 4
        return table.ravel()

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text; texts are taken a few million characters at a time."""
        langs, scores, a = [], [], 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and (b == a or size + len(texts[b] or "") <= AT_ONCE):
                size, b = size + len(texts[b] or ""), b + 1
            some = self._predict(texts[a:b])
            langs, scores, a = langs + some[0], scores + some[1], b
        return langs, scores

    def _predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lookup, is_letter = _classes(self.letters, self.width)
        whole = [t or "" for t in texts]
        points = np.frombuffer("".join(whole).encode("utf-32-le"), np.uint32)
        doc = np.repeat(np.arange(len(whole)), np.fromiter(map(len, whole), np.int64, len(whole)))
        has_letter = np.zeros(len(whole), bool)
        has_letter[doc[is_letter[points]]] = True
        symbols = lookup[points]
        keep = np.ones(len(symbols), bool)  # runs of other characters count as one
        keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0) | (doc[1:] != doc[:-1])
        symbols, doc = symbols[keep], doc[keep]
        sizes = np.bincount(doc, minlength=len(whole))
        bits = self._bits(symbols, sizes) if self.languages else np.zeros((0, len(whole)))
        langs, scores = [], []
        for i in range(len(whole)):
            if not self.languages or not has_letter[i]:
                langs.append(UNKNOWN), scores.append(0.0)
                continue
            h = bits[:, i] / sizes[i]
            best = int(np.argmin(h))
            langs.append(self.languages[best])
            scores.append(float(1 / np.sum(np.exp2(-SHARPNESS * (h - h[best])))))
        return langs, scores

    def _bits(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Per language and text: phrases times log2 of the language's size. symbols: of all texts in a row."""
        counts = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(sizes)), counts)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        begin = np.repeat(np.cumsum(sizes) - sizes, counts) + within * STRETCH
        length = np.minimum(STRETCH, sizes[owner] - within * STRETCH)
        out = np.zeros((len(self.languages), len(sizes)))
        for k, (table, narrow) in enumerate(zip(self.tables, self.narrow)):
            mine = narrow[symbols]
            state, ended = np.empty(len(mine), table.dtype), np.empty(len(mine), np.int8)
            lanes = np.argsort(-length, kind="stable")
            at = np.zeros(len(lanes), table.dtype)
            active = len(lanes) - np.searchsorted(length[lanes][::-1], np.arange(STRETCH), side="right")
            for t in range(int(length.max(initial=0))):
                place = begin[lanes[: active[t]]] + t
                step = table.take(at[: active[t]] + mine[place])
                ended[place] = step & 3
                state[place] = at[: active[t]] = step >> 2
            last = begin + length - 1
            lanes = np.flatnonzero(within > 0)
            lanes = lanes[state[last[lanes - 1]] != 0]
            while len(lanes):  # entered in the state before, until the ways meet
                at, again = state[last[lanes - 1]], []
                for t in range(STRETCH):
                    over = length[lanes] <= t
                    if over.any():  # the way changed to the end of the stretch, so its successor's begins elsewhere
                        again.append(lanes[over])
                        lanes, at = lanes[~over], at[~over]
                    if not len(lanes):
                        break
                    place = begin[lanes] + t
                    step = table.take(at + mine[place])
                    ended[place] = step & 3
                    met = state[place] == step >> 2
                    state[place] = step >> 2
                    lanes, at = lanes[~met], (step >> 2)[~met]
                again = np.concatenate([*again, lanes]) + 1
                again = again[again < len(owner)]
                lanes = again[within[again] > 0]
            phrases = np.add.reduceat(ended.astype(np.int64), begin[within == 0]) if len(owner) else np.zeros(0, np.int64)
            some = np.flatnonzero(counts)
            ends = last[np.cumsum(counts)[some] - 1]
            out[k, some] = (phrases + (state[ends] != 0)) * math.log2(self.sizes[k])
        return out


_tables: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _classes(letters: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For every code point: its symbol, and whether it is a letter."""
    if letters not in _tables:
        _tables.clear()
        is_letter = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
        lookup = np.where(is_letter, np.uint8(width - 1) if width <= 256 else np.uint16(width - 1), 0)
        for i, c in enumerate(letters):
            for x in {c, c.upper(), c.title()}:
                if len(x) == 1:
                    lookup[ord(x)] = i + 1
        _tables[letters] = lookup, is_letter
    return _tables[letters]


def fit(labelled: DataFrame, sample: Sample = Sample()) -> CrossParser:
    """labelled(text, lang) -> automata; only the bounded sample comes to the driver."""
    known = labelled.where(F.col("lang").isNotNull() & (F.char_length("text") > 0)).select("text", "lang")
    distinct = known.select("lang", F.xxhash64("text").alias("h")).distinct()
    n_langs = distinct.agg(F.count_distinct("lang")).first()[0]
    each = MOST_LANGUAGES * sample.sample_docs * sample.sample_chars // max(n_langs, MOST_LANGUAGES)  # characters a language
    chars = max(1, min(sample.sample_chars, each))
    n_docs = max(1, min(sample.sample_docs, each // chars))
    chosen = distinct.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("n") <= n_docs)
    most = F.ceil(F.lit(n_docs) / F.max("n").over(Window.partitionBy("lang"))).cast("int").alias("most")
    size, i = F.char_length("text"), F.col("i")
    whole = size <= F.col("most") * chars
    pieces = F.when(whole, F.ceil(size / chars)).otherwise(F.col("most")).cast("int")
    place = F.when(whole, i * chars).otherwise(F.pmod(F.xxhash64("h", "i"), size - chars + 1)).cast("int") + 1
    rows = (
        known.withColumn("h", F.xxhash64("text"))
        .join(F.broadcast(chosen.select("lang", "h", most)), ["lang", "h"])  # at most the sample's number of rows
        .select("lang", "h", "text", "most", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("i"))
        .select("lang", "h", "i", F.substring("text", place, F.lit(chars)).alias("text"))
        .distinct()
        .collect()
    )
    texts: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["i"], r["h"])):
        got = texts.setdefault(r["lang"], [])
        if len(got) < n_docs:
            got.append(r["text"])
    return CrossParser(texts)


def predict(df: DataFrame, parser: CrossParser, text: Column) -> Column:
    """struct(lang_pred, score) of a text; the automata are broadcast, their size is bounded by the sample."""
    shared = df.sparkSession.sparkContext.broadcast(parser)

    @F.arrow_udf("lang_pred string, score double")
    def parse(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        for a in range(0, len(texts), SLICE):
            some = shared.value.predict(texts.slice(a, SLICE).to_pylist())
            langs, scores = langs + some[0], scores + some[1]
        release()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return parse(text)


def identify(docs: DataFrame, labelled: DataFrame, sample: Sample = Sample()) -> DataFrame:
    """docs with lang_pred and score; its columns of these names are replaced."""
    kept = docs.drop("lang_pred", "score")
    got = kept.withColumn("_p", predict(docs, fit(labelled, sample), F.col("text")))
    return got.select(*kept.columns, "_p.lang_pred", "_p.score")
