"""Language-model scoring by a weighted backoff automaton whose arcs are counted and weighted across the cluster.

Counts. All training tokens are counted. Every training word is in the model, and every longer n-gram that occurs at least
``least`` times and whose parts are in it, so the model grows with the corpus. Nothing of it passes through the driver but two
totals.

Model. Unigrams are add-one smoothed; higher orders use absolute discounting, and the rest of a context's mass goes to the weight
of its failure arc. The automaton's states are the model's contexts: a kept n-gram is an arc, and a state without an arc for
the next word fails to its longest proper suffix, at the failure arc's weight. A text is read once from left to right, and the state
is carried from word to word. All texts of a stretch are read together, in lanes: a state forgets all but the last words, so a lane
may begin inside a text, a few words earlier than it counts.

A stretch is a file row with some whole documents as word codes. In each round the stretches ask buckets for the counts of
their n-grams and for the failure weights of the contexts they pass (see ``packed``), so each has the part of the automaton that its
texts can reach, and carries it from round to round. Of an n-gram that several stretches have, one tells its context of it.

Keys. A word's key is its 64-bit hash, a longer n-gram's a mix of the keys of the n-grams without its last and without its first word.

Tokens: white-space words with A-Z lower-cased, then one end token, which no word equals.

Defined results. Null text: the end token only. Training set empty: N = 0, V = 0, every token has probability 1. Null id: not
learned from unless the training filter says so; scored. Repeated rows: each is counted and each is scored. Ties: none
arise. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucketed, discard, release, shuffle_partitions, stored
from .packed import DEALT, bucket_of, grouped, joined48, low48, rows, together, unpacked

END = xxhash.xxh3_64_intdigest(b" ")  # no word has a space in it
#: Tokens of a stretch, unless one document has more, and bytes of text for which there is a bucket.
STRETCH, BUCKET = 500_000, 8 << 20
#: Words of a lane.
LANE = 256
STATE = "batch bigint, n bigint, data binary"


@dataclass(frozen=True)
class Settings:
    """order: longest n-gram, 2 or more. least: count from which an n-gram of two or more words is kept."""

    order: int = 3
    least: int = 2
    discount: float = 0.6


def mixed(c: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Key of the n-gram whose parts without the last and the first word have the keys c and s."""
    x = c * np.uint64(0x9E3779B97F4A7C15) + s
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _narrow(x: np.ndarray) -> np.ndarray:
    """In as few bytes as the largest takes."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, learn, ask) -> a row of STATE for each stretch, n its training tokens."""
    number = TaskContext.get().partitionId() << 32
    ids, learn, ask, split, size = [], [], [], [], 0

    def stretch() -> pa.RecordBatch:
        lengths = np.fromiter(map(len, split), np.int64, len(split)) + 1
        coded = pa.array([*chain.from_iterable(split)], pa.binary()).dictionary_encode()
        hashes = np.array([*map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), END], np.uint64)
        words, place = np.unique(hashes, return_inverse=True)
        codes = np.full(lengths.sum(), place[-1])
        inside = np.ones(len(codes), bool)
        inside[np.cumsum(lengths) - 1] = False
        codes[inside] = place[coded.indices.to_numpy()]
        data = (ids, np.array(learn), np.array(ask), lengths, words, codes.astype(np.uint16), _narrow(codes >> 16))
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([int(lengths[np.array(learn)].sum())]), pa.array([pickle.dumps(data, 5)], pa.binary())], ["batch", "n", "data"])

    for batch in batches:
        for a in range(0, batch.num_rows, 512):
            part = batch.slice(a, 512)
            for i, t, x, y in zip(*(part.column(c).to_pylist() for c in range(4))):
                ids.append(i)
                split.append((t or "").encode().lower().split())
                learn.append(x)
                ask.append(y)
                size += len(split[-1]) + 1
                if size > STRETCH:
                    yield stretch()
                    number, ids, learn, ask, split, size = number + 1, [], [], [], [], 0
    if ids:
        yield stretch()


def _taken(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """values[at]; what stands for -1 is not used."""
    return values[at] if len(values) else np.zeros(len(at), values.dtype)


class Stretch:
    """A stretch with what it has been told: per order the keys of its n-grams, which of them stands at each place, counts, weights."""

    def __init__(self, data: pa.Scalar, told: list[pa.Scalar], settings: Settings):
        self.ids, self.learn, self.ask, self.lengths, words, low, high = unpacked(data)
        self.settings = settings
        code = low.astype(np.int64) | high.astype(np.int64) << 16
        starts = np.cumsum(self.lengths) - self.lengths
        self.place = np.arange(len(code)) - np.repeat(starts, self.lengths)
        self.starts, self.learned = starts, np.repeat(self.learn, self.lengths)
        self.keys, self.at = [words], [code]  # by order; at: -1 where no n-gram of the order ends
        self.counts, self.tells, self.weights = [], [], []
        self._extend()
        for round_, parts in enumerate(map(unpacked, told)):
            answer = [*map(np.concatenate, parts)]
            if round_:
                weights = np.zeros(len(self.keys[round_ - 1]))
                weights[self.asked(round_)] = answer[0]
                self.weights.append(weights)
            for count in answer[1 if round_ else 0 :]:
                self.counts.append((count >> 1).astype(np.int64))
                self.tells.append(count & 1 == 1)
            if len(self.counts) == len(self.keys) < settings.order:
                self._extend()

    def in_model(self, order: int) -> np.ndarray:
        """By n-gram, whether the model has it."""
        return self.counts[order - 1] >= (1 if order == 1 else self.settings.least)

    def kept(self, order: int) -> np.ndarray:
        """Per place, whether the n-gram that ends there is in the model."""
        at = self.at[order - 1]
        if len(self.counts) < order:
            return at >= 0
        return (at >= 0) & _taken(self.in_model(order), at)

    def _extend(self) -> None:
        """The n-grams of the next order: those whose parts are kept, as far as is known."""
        order = len(self.keys) + 1
        key, kept = _taken(self.keys[-1], self.at[-1]), self.kept(order - 1)
        here = (self.place >= order - 1) & kept & np.append(False, kept[:-1])
        ends = np.flatnonzero(here)
        grams, inside = np.unique(mixed(key[ends - 1], key[ends]), return_inverse=True)
        at = np.full(len(key), -1)
        at[ends] = inside
        self.keys.append(grams)
        self.at.append(at)

    def counted(self, order: int) -> np.ndarray:
        """Occurrences in training texts by n-gram."""
        at = self.at[order - 1]
        return np.bincount(at[(at >= 0) & self.learned], minlength=len(self.keys[order - 1]))

    def log_p(self, order: int, base: np.ndarray) -> np.ndarray:
        """Per place the log10 probability of the arc of this order that ends there; nan where there is none. base: by word."""
        if order == 1:
            return base[self.at[0]]
        out = np.full(len(self.place), np.nan)
        ends = np.flatnonzero(self.kept(order))
        of = self.counts[order - 2][self.at[order - 2][ends - 1]]
        out[ends] = np.log10((self.counts[order - 1][self.at[order - 1][ends]] - self.settings.discount) / of)
        return out

    def told_arcs(self, order: int) -> np.ndarray:
        """A place for each arc of contexts of this order that this stretch tells of."""
        ends = np.flatnonzero(self.kept(order + 1))
        ends = ends[np.unique(self.at[order][ends], return_index=True)[1]]
        return ends[self.tells[order][self.at[order][ends]]]

    def asked(self, order: int) -> np.ndarray:
        """By n-gram of this order, whether it is asked about as a context: it fails here, or has arcs that are told of."""
        out = self.fails(order)
        out[self.at[order - 1][self.told_arcs(order) - 1]] = True
        return out

    def told_contexts(self, order: int, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Contexts whose arcs are told of, as places among those asked about; these arcs' mass, and their mass without the context."""
        ends = self.told_arcs(order)
        which, place = np.unique(self.at[order - 1][ends - 1], return_inverse=True)
        mass = lambda k: np.bincount(place, 10.0 ** self.log_p(k, base)[ends], len(which))
        return (np.cumsum(self.asked(order)) - 1)[which], mass(order + 1), mass(order)

    def fails(self, order: int) -> np.ndarray:
        """By n-gram of this order, whether a word follows it somewhere that it may have no arc for: then its failure weight is wanted.

        An n-gram that is met less often than arcs has no arcs and fails without a loss.
        """
        out = np.zeros(len(self.keys[order - 1]), bool)
        context = np.append(-1, self.at[order - 1][:-1])
        ends = (self.place >= order) & (context >= 0) & ~(self.kept(order + 1) if order < len(self.keys) else np.zeros(len(self.place), bool))
        out[context[ends]] = True
        return out & (self.counts[order - 1] >= self.settings.least)

    def automaton(self, base: np.ndarray) -> Automaton:
        """The part of the automaton that these texts can reach."""
        words = len(base)
        first = np.cumsum([1, *map(len, self.keys[: self.settings.order - 1])])  # of the states of each order; 0 has no context
        fail, weight = np.zeros(first[-1], np.int64), np.zeros(first[-1])
        known = self.in_model(1)
        target = np.where(known, np.arange(words) + 1, 0)
        arcs, costs, targets = [], [], []
        for order in range(1, self.settings.order):
            weight[first[order - 1] : first[order]] = self.weights[order - 1]
            if order > 1:
                there = np.flatnonzero(self.kept(order))
                fail[first[order - 1] + self.at[order - 1][there]] = first[order - 2] + self.at[order - 2][there]
            ends = np.flatnonzero(self.kept(order + 1))
            ends = ends[np.unique(self.at[order][ends], return_index=True)[1]]
            arcs.append((first[order - 1] + self.at[order - 1][ends - 1]) * words + self.at[0][ends])
            costs.append(self.log_p(order + 1, base)[ends])
            longest = order + 1 < self.settings.order  # else the arc's words without the first
            targets.append(first[order if longest else order - 1] + self.at[order if longest else order - 1][ends])
        keys = np.concatenate(arcs)
        sort = np.argsort(keys)
        return Automaton(words, base, target, keys[sort], np.concatenate(costs)[sort], np.concatenate(targets)[sort], fail, weight)

    def score(self, base: np.ndarray) -> np.ndarray:
        """Per place the log10 probability of its token."""
        before = self.settings.order - 1
        counts = -(-self.lengths // LANE)
        text = np.repeat(np.arange(len(counts)), counts)
        begin = (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)) * LANE
        end = self.starts[text] + np.minimum(begin + LANE, self.lengths[text])
        return self.automaton(base).read(self.at[0], self.starts[text] + begin, self.starts[text] + np.maximum(begin - before, 0), end)


@dataclass
class Automaton:
    """States by number; 0 has no context, and an arc for every word. Other arcs are found by state * words + word."""

    words: int
    base: np.ndarray
    target: np.ndarray
    arcs: np.ndarray
    costs: np.ndarray
    targets: np.ndarray
    fail: np.ndarray
    weight: np.ndarray

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and log10 probabilities: along failure arcs until there is an arc."""
        total, after = np.zeros(len(state)), np.zeros(len(state), np.int64)
        left = np.arange(len(state))
        while len(left):
            start = state == 0
            key = state * self.words + word
            at = np.minimum(np.searchsorted(self.arcs, key), max(len(self.arcs) - 1, 0))
            there = ~start & (self.arcs[at] == key) if len(self.arcs) else np.zeros(len(key), bool)
            total[left[there]] += self.costs[at[there]]
            after[left[there]] = self.targets[at[there]]
            total[left[start]] += self.base[word[start]]
            after[left[start]] = self.target[word[start]]
            on = ~(start | there)
            left, state, word = left[on], state[on], word[on]
            total[left] += self.weight[state]
            state = self.fail[state]
        return after, total

    def read(self, code: np.ndarray, begin: np.ndarray, enter: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Lanes of a row of words, side by side: each is entered at `enter`, without context, and counts from `begin` to `end`."""
        out = np.zeros(len(code))
        order = np.argsort(enter - end, kind="stable")  # the longest first
        begin, place, end = begin[order], enter[order].copy(), end[order]
        state = np.zeros(len(order), np.int64)
        active = len(order)
        while True:
            active = int(np.searchsorted(-(end[:active] - place[:active]), 0))  # those that have ended stand last
            if not active:
                return out
            here = place[:active]
            state[:active], cost = self.step(state[:active], code[here])
            counts = here >= begin[:active]
            out[here[counts]] = cost[counts]
            place[:active] += 1


def _asks(stretch: Stretch, round_: int, base: np.ndarray) -> list[tuple]:
    """Of a round: n-grams with their counts as (keys, counts); contexts with what is told of some of them as (keys, places, values, values)."""
    if round_ == 0:
        return [(stretch.keys[order - 1], _narrow(stretch.counted(order))) for order in (1, 2)]
    asks: list[tuple] = [(stretch.keys[round_ - 1][stretch.asked(round_)], *stretch.told_contexts(round_, base))]
    if round_ + 2 <= stretch.settings.order:
        asks.append((stretch.keys[round_ + 1], _narrow(stretch.counted(round_ + 2))))
    return asks


def _by_bucket(ask: tuple, buckets: int) -> list[tuple]:
    """What goes to each bucket; keys in 48 bits."""
    keys, *values = ask
    ends = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
    parts = [*low48(keys)]
    if len(values) == 1:
        parts += values
        return [tuple(x[a:b] for x in parts) for a, b in zip(ends, ends[1:])]
    places, *told = values
    at = np.searchsorted(places, ends)
    return [(*(x[a:b] for x in parts), _narrow(places[i:j] - a), *(x[i:j] for x in told)) for a, b, i, j in zip(ends, ends[1:], at, at[1:])]


def _answer(bucket: int, parts: list[tuple[int, list]], first_round: bool) -> Iterator[tuple]:
    """Counts as twice the sum, and one for the part that tells of the n-gram; failure weights as log10."""
    answers: list[list[np.ndarray]] = [[] for _ in parts]
    for kind, asked in enumerate(zip(*(p for _, p in parts))):
        keys = np.concatenate([joined48(*a[:2]) for a in asked])
        sizes = [len(a[0]) for a in asked]
        order, first, times = grouped(keys)
        summed = lambda x: np.add.reduceat(x[order], first) if len(keys) else x
        if len(asked[0]) == 3:
            sums = summed(np.concatenate([a[2] for a in asked]).astype(np.int64))
            out = np.empty(len(keys), np.int64)
            out[order] = np.repeat(2 * sums, times)
            out[order[first]] += 1
            if first_round and kind == 0:
                yield bucket, -1, True, int((sums > 0).sum())
        else:
            at = np.concatenate([a[2].astype(np.int64) + before for a, before in zip(asked, np.cumsum([0, *sizes]))])
            told = np.zeros((2, len(keys)))
            told[:, at] = [np.concatenate([a[v] for a in asked]) for v in (3, 4)]
            arcs, lower = map(summed, told)
            out = np.empty(len(keys))
            left = [np.maximum(1 - x, 1e-12) for x in (arcs, lower)]  # positive but for rounding: lower orders leave mass to words never seen
            out[order] = np.repeat(np.where(arcs > 0, np.log10(left[0] / left[1]), 0.0), times)
        for mine, x in zip(answers, np.split(out, np.cumsum(sizes)[:-1])):
            mine.append(_narrow(x) if out.dtype == np.int64 else x)
    for (number, _), mine in zip(parts, answers):
        yield bucket, number, False, mine


def _round(state: DataFrame, round_: int, settings: Settings, totals: tuple[int, int], buckets: int, parts: int) -> DataFrame:
    """What the stretches are told in this round, as rows of STATE; under batch -1, n is the number of training words."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                stretch = Stretch(batch.column("data")[i], [batch.column(f"told{k}")[i] for k in range(round_)], settings)
                number = batch.column("batch")[i].as_py()
                kinds = [_by_bucket(x, buckets) for x in _asks(stretch, round_, _base(stretch, totals))]
                wanted = [b for b in range(buckets) if any(len(kind[b][0]) for kind in kinds)] or [0]  # an answer for every stretch
                for a in range(0, len(wanted), 512):
                    yield rows([(b, number, False, [kind[b] for kind in kinds]) for b in wanted[a : a + 512]])
        release()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, mine in together(batches, "bucket"):
            yield rows([*_answer(bucket, [(r[1], unpacked(r[3])) for r in mine], round_ == 0)])
        release()

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, mine in together(batches, "batch"):
            got = [unpacked(r[3]) for r in mine]
            n, data = (sum(got), None) if number < 0 else (None, pickle.dumps([*zip(*got)], 5))  # by bucket, as narrow as they came
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([n], pa.int64()), pa.array([data], pa.binary())], ["batch", "n", "data"])

    asked = state.mapInArrow(ask, DEALT).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    answered = stored(asked.mapInArrow(answer, DEALT), "answers")  # the questions go before the answers are sorted
    told = answered.repartition(parts, "batch").sortWithinPartitions("batch", "bucket")
    out = bucketed(told.mapInArrow(tell, STATE), "batch", parts, "told")
    discard(answered)
    return out


def _base(stretch: Stretch, totals: tuple[int, int]) -> np.ndarray:
    """log10 of a word's unigram probability."""
    if not stretch.counts:
        return np.zeros(len(stretch.keys[0]))
    return np.log10((stretch.counts[0] + 1) / float(sum(totals) + 1))


def score_rows(docs: DataFrame, learn: Column, ask: Column, settings: Settings = Settings()) -> DataFrame:
    """docs(doc_id, text): the rows that `ask` chooses, scored by a model of those that `learn` chooses.

    -> doc_id, n_tokens, n_known, train_tokens, base_score, score.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = docs.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learn"), F.coalesce(ask, F.lit(False)).alias("ask"))
    parts = shuffle_partitions(docs.sparkSession)
    buckets = max(parts, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET))
    tables = [bucketed(marked.mapInArrow(_stretches, STATE), "batch", parts, "stretches")]
    totals = (tables[0].agg(F.sum("n")).first()[0] or 0, 0)

    def state() -> DataFrame:
        out = tables[0].select("batch", "data")
        for k, table in enumerate(tables[1:]):
            out = out.join(table.select("batch", F.col("data").alias(f"told{k}")), "batch")
        return out

    for round_ in range(settings.order):
        tables.append(_round(state(), round_, settings, totals, buckets, parts))
        if round_ == 0:
            totals = totals[0], tables[1].where("batch = -1").agg(F.sum("n")).first()[0] or 0

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                s = Stretch(batch.column("data")[i], [batch.column(f"told{k}")[i] for k in range(settings.order)], settings)
                base = _base(s, totals)
                by_text = lambda x: np.add.reduceat(x, s.starts)[s.ask]
                out = [s.lengths[s.ask], by_text((s.counts[0] > 0)[s.at[0]].astype(np.int64)), by_text(base[s.at[0]]), by_text(s.score(base))]
                ids = pa.array([d for d, y in zip(s.ids, s.ask) if y], batch_type)
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, out)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(docs.schema["doc_id"].dataType)
    out = stored(state().mapInArrow(scored, f"doc_id {kind}, n_tokens bigint, n_known bigint, base_score double, score double"), "scores")
    for table in tables:
        discard(table)
    return out.select("doc_id", "n_tokens", "n_known", F.lit(totals[0]).cast("long").alias("train_tokens"), "base_score", "score")


def score(docs: DataFrame, train: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs(doc_id, text) scored by a model of train(text); see score_rows, which reads texts once that are in both."""
    both = docs.select("doc_id", "text", F.lit(False).alias("_train")).unionAll(train.select(F.lit(None).cast(docs.schema["doc_id"].dataType), "text", F.lit(True)))
    return score_rows(both, F.col("_train"), ~F.col("_train"), settings)
