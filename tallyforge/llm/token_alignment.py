"""Cross-tokenizer alignment by a dangling-suffix transducer.

Two tokenizers cut the same bytes. The transducer reads their tokens by turns: its state is which side leads and the residual, the
leader's bytes that the other side hasn't matched yet, and the side that is behind reads next (A, where there is no residual).
The next token is either a prefix of the residual, or begins with it and so takes the lead with what remains, or the bytes differ.
An empty residual closes a group. Transitions are remembered by state and next token, so bytes are compared once for each
pair that occurs, and a text costs a lookup for each of its tokens.

A single space between two characters that are not white space begins a token on either side, if A splits text by the usual pattern
and no piece of B goes on with a space behind anything else; the residual is empty there. So texts are cut at such spaces: what a
worker has aligned is remembered by cut, within a bound, and a text's new cuts are aligned in one go. Where the files don't allow
that, texts are aligned whole.

A group's last tokens end together: they are its link. How often the corpus links a pair of ids is counted by Spark, and each
document's distinct pairs are joined with these counts, which are broadcast only where their number, once known, is small.

A is a byte-level BPE of a tokenizers file, B a SentencePiece model that puts a space before the text; A is given that space. If the
file's ranks are its ids, tiktoken merges by them (the same tokens in a quarter of the time), else the tokenizers library does, as
it does for texts with white space too long for tiktoken. Special tokens are plain text.

Defined results. Null and empty texts, and texts whose bytes B changes (a U+2581, what its normalisation alters): no tokens, no
groups, zeros. Very long texts are aligned whole. Ties: links whose count equals the highest of their B id are all best. Repeated
rows: each is counted and returned; so are null ids. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import broadcast_if, discard, stored

#: The pattern by which byte-level BPE of this kind splits text before merging (a fixed value of the format).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space that tiktoken's pattern is not trusted with.
RUN = re.compile(r"\s{4000}")
#: A space where both sides begin a token.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Transitions, and characters of cuts, that a worker remembers before it begins anew.
MEMO, CUTS = 1_000_000, 3_000_000
#: Pairs of ids that are broadcast at most (32 bytes each).
PAIRS = 1_000_000
#: Documents that leave a worker together.
ROWS = 256


class ByteLevel:
    """Side A: ids of a text, and each id's bytes."""

    def __init__(self, file: bytes):
        spec = json.loads(file)
        self.file, model = file, spec["model"]
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves; others follow from 0x100 on
        byte_of = {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
        special = {t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in model["vocab"].items() if i not in special}
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.pieces[i] = piece
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        split = spec["pre_tokenizer"] or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec["normalizer"]
        if plain and not model.get("ignore_merges") and all(model["vocab"].get(m) == 256 + k for k, m in enumerate(merged)) and len(merged) + 256 == len(ranks):
            import tiktoken

            self.fast = tiktoken.Encoding("A", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        else:
            self.fast = None
        self.cuts = plain

    @functools.cached_property
    def slow(self):
        from tokenizers import Tokenizer

        out = Tokenizer.from_buffer(self.file)
        out.encode_special_tokens = True  # their strings in a text are text
        return out

    def encode(self, text: str) -> list[int]:
        if self.fast and not (len(text) > 4000 and RUN.search(text)):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


class Pieces:
    """Side B: ids of a text, and each id's bytes."""

    def __init__(self, file: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_proto=file)
        spec = sentencepiece_model_pb2.ModelProto.FromString(file)
        normal, kinds = spec.normalizer_spec, spec.trainer_spec
        keeps = normal.add_dummy_prefix and normal.escape_whitespaces and not (normal.remove_extra_whitespaces or normal.precompiled_charsmap or kinds.treat_whitespace_as_suffix)
        self.cuts = keeps and kinds.model_type == kinds.BPE and all(re.fullmatch("▁*[^▁]*", p.piece) for p in spec.pieces)
        n = self.model.get_piece_size()
        self.pieces = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.model.id_to_piece, range(n)))]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


class State(dict):
    """A leader with a residual: what follows each token of the side that reads next. False: the bytes differ."""

    __slots__ = ("machine", "leader", "residual", "reads_b")

    def __init__(self, machine: Transducer, leader: int, residual: bytes):
        self.machine, self.leader, self.residual, self.reads_b = machine, leader, residual, leader == 0

    def __missing__(self, token: int) -> State | bool:
        following = self[token] = self.machine.step(self, token)
        return following


class Transducer:
    """States by leader (0: A, 1: B) and residual; without a residual A reads. Transitions are remembered in the states."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.tokens, self.steps = (a, b), 0
        self._forget()

    def _forget(self) -> None:
        self.remembered = 0
        self.start = State(self, 1, b"")
        self.states = {(1, b""): self.start}

    def step(self, state: State, token: int) -> State | bool:
        """Compares a token with the residual; where this is done once, the transition is known."""
        self.steps, self.remembered = self.steps + 1, self.remembered + 1
        leader, residual = state.leader, state.residual
        piece = self.tokens[1 - leader][token]
        if residual.startswith(piece):
            following = leader, residual[len(piece) :]
        elif piece.startswith(residual):
            following = 1 - leader, piece[len(residual) :]
        else:
            return False
        if not following[1]:
            return self.start
        if following not in self.states:
            self.states[following] = State(self, *following)
        return self.states[following]

    def groups(self, a: list[int], b: list[int]) -> tuple[list[int], list[int]] | None:
        """How many tokens of A and of B stand before the end of each group; None if the bytes differ."""
        if self.remembered > MEMO:
            self._forget()
        start, ends_a, ends_b = self.start, [], []
        i = j = 0
        n, m = len(a), len(b)
        try:
            while i < n:
                state = start[a[i]]
                i += 1
                while state is not start:
                    if state.reads_b:
                        state = state[b[j]]
                        j += 1
                    else:
                        state = state[a[i]]
                        i += 1
                ends_a.append(i)
                ends_b.append(j)
        except (IndexError, AttributeError):  # one side ended, or the bytes differ
            return None
        return (ends_a, ends_b) if j == m else None


class Aligner:
    """Both tokenizers of a worker, and the transducer."""

    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b = a, b
        self.transducer = Transducer(a.pieces, b.pieces)
        self.width = max(len(a.pieces), len(b.pieces))
        self.digits = [*map(str, range(self.width))]
        self.begins = {i for i, p in enumerate(a.pieces) if p[:1] == b" "}
        self.cuts = a.cuts and b.cuts
        self.known: dict[str, tuple] = {}
        self.size = 0

    def align(self, text: str | None) -> tuple[list[int], list[int], list[int], list[int]] | None:
        """ids of A and of B, and for each group how many of them stand before its end."""
        if not text:
            return None
        a, b = self.a.encode(" " + text), self.b.encode(text)
        if b"".join(map(self.a.pieces.__getitem__, a)) != b" " + text.encode():
            return None
        ends = self.transducer.groups(a, b)
        return ends and (a, b, *ends)

    def cut(self, text: str) -> list[tuple[int, int, str, bytes]] | None:
        """For each cut of a text, all of whose spaces cut it: numbers of tokens, its groups as `a1,a2|b1;a3|b2,b3`, its links as numbers."""
        got = self.align(text)
        if got is None:
            return None
        a, b, ends_a, ends_b = got
        links = (np.array([a[k - 1] for k in ends_a]) * self.width + np.array([b[k - 1] for k in ends_b])).tobytes()
        begins, digits = self.begins, self.digits
        name_a, name_b = [*map(digits.__getitem__, a)], [*map(digits.__getitem__, b)]
        out, groups, i, j, i0, j0, g0 = [], [], 0, 0, 0, 0, 0
        for g, (k, m) in enumerate(zip(ends_a, ends_b)):
            if a[i] in begins and i:
                out.append((i - i0, j - j0, ";".join(groups), links[8 * g0 : 8 * g]))
                groups, i0, j0, g0 = [], i, j, g
            groups.append((name_a[i] if k - i == 1 else ",".join(name_a[i:k])) + "|" + (name_b[j] if m - j == 1 else ",".join(name_b[j:m])))
            i, j = k, m
        out.append((i - i0, j - j0, ";".join(groups), links[8 * g0 :]))
        return out

    def _whole(self, text: str) -> tuple | None:
        """The same of a whole text."""
        parts = self.cut(text)
        return parts and (sum(p[0] for p in parts), sum(p[1] for p in parts), ";".join(p[2] for p in parts), b"".join(p[3] for p in parts))

    def parts(self, text: str) -> list[tuple] | None:
        """What a text is put together of, in order; None if the bytes differ."""
        if not self.cuts:
            whole = self._whole(text)
            return whole and [whole]
        if self.size > CUTS:
            self.known, self.size = {}, 0
        cuts, known = CUT.split(text), self.known
        new = [c for c in dict.fromkeys(cuts) if c not in known]
        plain, odd = [c for c in new if " " not in c], [c for c in new if " " in c]
        got = [self.cut(" ".join(plain)) if plain else [], *map(self._whole, odd)]
        if None in got:
            return None
        known.update(zip(plain, got[0], strict=True))
        known.update(zip(odd, got[1:]))
        self.size += sum(map(len, new))
        return [known[c] for c in cuts]

    def summary(self, text: str | None) -> tuple:
        """n_a, n_b, n_groups, digest of the groups, and the distinct links (a, b, how many)."""
        parts = self.parts(text) if text else None
        if parts is None:
            return 0, 0, 0, "", *[np.empty(0, np.int32)] * 3
        n_a, n_b, written, links = zip(*parts)
        linked = np.frombuffer(b"".join(links), np.int64)
        pairs, many = np.unique(linked, return_counts=True)
        digest = hashlib.sha256(";".join(written).encode()).hexdigest()
        return sum(n_a), sum(n_b), len(linked), digest, *(x.astype(np.int32) for x in (pairs // self.width, pairs % self.width, many))


@functools.lru_cache(maxsize=1)
def _aligner(a: bytes, b: bytes) -> Aligner:
    return Aligner(ByteLevel(a), Pieces(b))


class Tokenizers:
    """The two files, read on the driver and broadcast (a few MB)."""

    def __init__(self, spark: SparkSession, byte_level: str, pieces: str):
        self.files: Broadcast = spark.sparkContext.broadcast((Path(byte_level).read_bytes(), Path(pieces).read_bytes()))


#: Of a row of the input: row, doc_id, counts, the digest of its groups, and its distinct linked pairs with their numbers of links.
_ALIGNED = "row bigint, doc_id {}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, a array<int>, b array<int>, links array<int>"


def aligned(docs: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """docs(doc_id, text) -> a row for each row, see _ALIGNED. `row` numbers them anew in every run, so store it before it is read twice."""
    files, kind = tokenizers.files, docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, row = _aligner(*files.value), TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = part.column(1).dictionary_encode()  # copies are aligned once
                each = [aligner.summary(t.as_py()) for t in texts.dictionary]
                none = aligner.summary(None)
                rows = [none if k is None else each[k] for k in texts.indices.to_pylist()]
                *plain, a, b, links = zip(*rows)
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate(x))) for x in (a, b, links)]
                arrays = [pa.array(np.arange(row, row + len(rows))), part.column(0), *(pa.array(x, t) for x, t in zip(plain, (pa.int64(), pa.int64(), pa.int64(), pa.string()))), *lists]
                row += len(rows)
                yield pa.RecordBatch.from_arrays(arrays, ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "a", "b", "links"])

    return docs.select("doc_id", "text").mapInArrow(run, _ALIGNED.format(kind.simpleString()))


def alignments(docs: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """docs(doc_id, text) -> doc_id and its groups: a and b, arrays of id arrays; null without tokens."""
    files, kind = tokenizers.files, docs.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*files.value)
        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1)):
                got = aligner.align(text.as_py())
                cut = [None, None] if got is None else [[ids[i:k] for i, k in zip([0, *ends], ends)] for ids, ends in ((got[0], got[2]), (got[1], got[3]))]
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()], arrow), *(pa.array([x], pa.list_(pa.list_(pa.int32()))) for x in cut)], ["doc_id", "a", "b"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, a array<array<int>>, b array<array<int>>")


def _links(rows: DataFrame) -> DataFrame:
    return rows.select("row", F.inline(F.arrays_zip("a", "b", "links")))


def link_counts(rows: DataFrame) -> DataFrame:
    """What aligned() gives -> a, b, how often the corpus links them (count), whether no A id is linked with b more often (best)."""
    counts = _links(rows).groupBy("a", "b").agg(F.sum("links").alias("count"))
    pairs = stored(counts, "pairs")
    highest = pairs.groupBy("b").agg(F.max("count").alias("highest"))
    return pairs.join(highest, "b").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))


def align(docs: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows = stored(aligned(docs, tokenizers), "aligned")
    counts = stored(link_counts(rows), "counts")
    met = _links(rows).join(broadcast_if(counts.count() <= PAIRS, counts), ["a", "b"])
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("count")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = stored(rows.drop("a", "b", "links").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256"), "alignment")
    for table in (rows, counts):
        discard(table)
    return out
