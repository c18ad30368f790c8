"""Detection and masking of personal and account identifiers.

A Column filter keeps texts that can't hold any away from Python. There a text is cut into words, and the shapes of one to four
words in a row (`5A4D1A`: five letters, four digits, a letter) are looked up in a table of identifier shapes; check digits
and words nearby decide the score. Which candidates stand, and what is masked, is worked out by array functions in Columns.
Findings never carry the matched text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Scores, threshold, context window and boost; shapes by type; context words; payment suffixes; harmless words.
STRONG, SHAPE, GATED, THRESHOLD, BOOST, WINDOW = 0.85, 0.6, 0.3, 0.5, 0.4, 40
UPI_SUFFIXES = ("upi", "ybl", "okaxis", "okhdfcbank", "okicici", "oksbi", "paytm", "apl", "axl", "ibl", "icici", "sbi", "hdfcbank", "axisbank")
CONTEXT = {
    "PAN": ("pan", "permanent account number", "income tax"),
    "AADHAAR": ("aadhaar", "aadhar", "adhaar", "uidai", "uid", "आधार"),
    "BANK_ACCOUNT": ("account", "a/c", "acct", "acc no", "acc. no", "ac no", "ac. no", "ifsc", "bank", "savings", "beneficiary"),
    "DEMAT_ID": ("demat", "dp id", "dp-id", "dpid", "bo id", "boid", "beneficiary owner", "client id", "cdsl", "nsdl", "depository"),
    "CARD": ("card", "credit", "debit", "visa", "mastercard", "rupay", "amex", "maestro", "cvv"),
    "UPI_ID": ("upi", "vpa", "gpay", "phonepe", "paytm", "bhim"),
    "PASSPORT": ("passport", "travel document"),
    "VOTER_ID": ("voter", "epic", "elector", "election card", "election id", "electoral"),
}
TYPES = tuple(CONTEXT)
#: (type, shapes of the words, what may stand between them, score). M is a masked character.
SHAPES = (
    ("PAN", ("5A4D1A",), "", SHAPE), ("PAN", ("5A", "4D", "1A"), " -", GATED), ("PAN", ("5A", "4D1A"), " -", GATED), ("PAN", ("5A4D", "1A"), " -", GATED),
    ("AADHAAR", ("12D",), "", SHAPE), ("AADHAAR", ("4D", "4D", "4D"), " -", SHAPE), ("AADHAAR", ("8M4D",), "", GATED), ("AADHAAR", ("4M", "4M", "4D"), " -", GATED),
    *(("BANK_ACCOUNT", (f"{n}D",), "", GATED) for n in range(9, 19)),
    ("DEMAT_ID", ("2A14D",), "", STRONG), ("DEMAT_ID", ("2A6D", "8D"), " -", STRONG), ("DEMAT_ID", ("16D",), "", GATED), ("DEMAT_ID", ("8D", "8D"), " -", GATED),
    *(("CARD", (f"{n}D",), "", GATED) for n in range(13, 20)), *(("CARD", ("4D", "4D", "4D", f"{n}D"), " -", GATED) for n in range(1, 8)), *(("CARD", ("4D", "6D", f"{n}D"), " -", GATED) for n in (4, 5)),
    ("PASSPORT", ("1A7D",), "", GATED), ("PASSPORT", ("1A", "7D"), " ", GATED),
    ("VOTER_ID", ("3A7D",), "", GATED), ("VOTER_ID", ("3A", "7D"), " /-", GATED),
)
#: Types whose parts are all divided by the same character.
EVEN = ("AADHAAR", "CARD")
HARMLESS_SHAPES = {"1A5D2A4D3A6D"}  # company number
CURRENCY = r"(?:₹|[$€£]|\b(?:rs\.?|inr|usd|eur|gbp))\s?"
AMOUNT = r"[0-9][0-9,]*(?:\.[0-9]+)?"
AMOUNT_OF = r"\s?(?:%|(?:lakhs?|lacs?|crores?|cr|mn|millions?|bn|billions?|thousands?|trillions?|tn|shares|units)\b)"
#: A listed share's symbol, and a telephone number: a plus or a label, then groups of digits up to the fifteen of E.164.
SYMBOL = r"[a-z0-9&]{1,12}(?:-[a-z0-9&]+)*"
PHONE_LABELS = ("cell", "fax", "mob", "mobile", "ph", "phone", "tel", "telephone")
PHONE = rf"(?:\+|\b(?:{'|'.join(sorted(PHONE_LABELS, key=len, reverse=True))})\b[^\w+]{{0,9}}\+?)\(?[0-9]{{1,5}}\)?(?:[ -]{{0,2}}\(?[0-9]{{1,6}}\)?){{1,14}}(?![0-9])"
HARMLESS = (
    f"{CURRENCY}{AMOUNT}", rf"\b{AMOUNT}{AMOUNT_OF}", r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+", rf"\b(?:bse|nse)\s?[:-]\s?{SYMBOL}", rf"\b{SYMBOL}\.(?:bo|ns)\b",
    r"\b[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}(?:[T ][0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?)?\b", r"\b[A-Z]{3}-[0-9]{4}\b", PHONE,
)
# The dihedral group's multiplication and permutation rows behind the Aadhaar check digit.
DIHEDRAL = ("0123456789", "1234067895", "2340178956", "3401289567", "4012395678", "5987604321", "6598710432", "7659821043", "8765932104", "9876543210")
PERMUTED = ("0123456789", "1576283094", "5803796142", "8916043527", "9453126870", "4286573901", "2793806415", "7046913258")

_shapes: dict[tuple[str, ...], list[tuple[str, str, float]]] = {}
for _type, _words, _between, _score in SHAPES:
    _shapes.setdefault(_words, []).append((_type, _between, _score))
_most = max(map(len, _shapes))
_harmless = re.compile("|".join(HARMLESS), re.I)
_word = re.compile(r"(?:[^\W_]|[*•])+")
_payee = re.compile(r"([A-Za-z0-9][A-Za-z0-9._-]*)@([A-Za-z0-9]+)(?![A-Za-z0-9_-]|\.[A-Za-z0-9])")


class _Folding(dict):
    """What a character outside ASCII reads as: digits of any script, full-width forms, dashes, odd spaces; one for one."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = unicodedata.category(c)
        if kind == "Nd":
            new = str(unicodedata.decimal(c))
        elif 0xFF01 <= code <= 0xFF5E:
            new = chr(code - 0xFEE0)
        else:
            new = "-" if kind == "Pd" or c == "−" else " " if kind in ("Zs", "Cf") else c
        self[code] = new
        return new


_folding = _Folding()


def fold(text: str) -> str:
    return text if text.isascii() else text.translate(_folding)


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def verhoeff(digits: str) -> bool:
    c = 0
    for i, d in enumerate(reversed(digits)):
        c = int(DIHEDRAL[c][int(PERMUTED[i % 8][int(d)])])
    return c == 0


def _kind(c: str) -> str:
    return "D" if c in "0123456789" else "M" if c in "*•" else "A" if c.isascii() else "?"


def shape(word: str) -> str:
    """Runs of letters, digits and masked characters with their lengths; a run of X counts as masked."""
    runs = ["".join(run) for _, run in groupby(word, _kind)]
    return "".join(f"{len(run)}{'M' if len(run) >= 4 and set(run) <= set('Xx') else _kind(run[0])}" for run in runs)


def _holds(kind: str, said: str, text: str, start: int, end: int) -> bool:
    """Check digits and the rules that a shape can't tell."""
    digits = "".join(c for c in said if c.isdigit())
    if said[0].isdigit() and (start > 1 and text[start - 1] in ".," and text[start - 2].isdigit()) or said[-1].isdigit() and text[end : end + 1] in (".", ",") and text[end + 1 : end + 2].isdigit():
        return False
    if start and text[start - 1] == "_" or text[end : end + 1] == "_":
        return False
    if kind == "CARD":
        return 13 <= len(digits) <= 19 and len(set(digits)) > 1 and luhn(digits)
    if kind == "AADHAAR" and len(digits) == 12:
        return digits[0] >= "2" and verhoeff(digits)
    if kind == "AADHAAR":
        return not (start > 1 and text[start - 1] in " -" and (text[start - 2].isdigit() or text[start - 2] in "Xx*•"))
    return kind != "DEMAT_ID" or not said[0].isalpha() or said[:2].upper() == "IN"


def _near(low: str, kind: str, start: int, end: int) -> bool:
    """Whether a context word begins or ends in the window on either side."""
    for a, b in ((max(0, start - WINDOW), start), (end, end + WINDOW)):
        window = " ".join(low[a:b].split())
        for phrase in CONTEXT[kind]:
            at = window.find(phrase)
            while at >= 0:
                if not (window[at - 1].isalnum() and window[at - 1].isascii() if at else a and low[a : a + 1] == phrase[0] and low[a - 1].isalnum()):
                    return True
                at = window.find(phrase, at + 1)
    return False


def candidates(text: str, upi_suffixes: Sequence[str] = UPI_SUFFIXES) -> Iterator[tuple[str, int, int, float, bool]]:
    """(type, start, end, score, whether a context word is near) of all that scores enough."""
    text = fold(text)
    low = text.lower()
    words = [(shape(m[0]), m.start(), m.end()) for m in _word.finditer(text)]
    found = [("UPI_ID", m.start(), m.end(), STRONG) for m in _payee.finditer(text) if len(m[1]) > 1 and m[2].lower() in upi_suffixes]
    for i, (_, start, _) in enumerate(words):
        between = ""
        for j in range(i, min(len(words), i + _most)):
            end = words[j][2]
            if j > i:
                if words[j][1] != words[j - 1][2] + 1:
                    break
                between += text[words[j][1] - 1]
            for kind, allowed, score in _shapes.get(tuple(w[0] for w in words[i : j + 1]), ()):
                if set(between) <= set(allowed) and not (kind in EVEN and len(set(between)) > 1) and _holds(kind, text[start:end], text, start, end):
                    found.append((kind, start, end, score))
    for kind, start, end, score in found:
        near = _near(low, kind, start, end)
        if (score := min(1.0, score + BOOST * near)) >= THRESHOLD:
            yield kind, start, end, round(score, 4), near


def harmless(text: str) -> Iterator[tuple[int, int]]:
    """Spans of amounts, dates, phone numbers, addresses, exchange symbols and numbers of companies, securities and tax."""
    text = fold(text)
    yield from (m.span() for m in _harmless.finditer(text))
    for m in _word.finditer(text):
        word, of = m[0], shape(m[0])
        tax = len(word) == 15 and of.startswith("2D5A4D1A") and word[13] in "Zz"
        security = len(word) == 12 and word[:2].isalpha() and word[-1].isdigit() and not word[2:].isdigit() and word.isascii()
        if tax or security or of in HARMLESS_SHAPES and word[0] in "LUlu":
            yield m.span()


FINDINGS = T.ArrayType(T.StructType().add("type", "string").add("start", "integer").add("end", "integer").add("score", "double"))
_CANDIDATES = T.StructType().add("found", T.ArrayType(T.StructType().add("start", "integer").add("end", "integer").add("near", "boolean").add("score", "double").add("order", "integer").add("type", "string"))).add(
    "harmless", T.ArrayType(T.StructType().add("start", "integer").add("end", "integer"))
)
_ARROW = pa.struct([
    ("found", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("near", pa.bool_()), ("score", pa.float64()), ("order", pa.int32()), ("type", pa.string())]))),
    ("harmless", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
])


def _candidates(text: Column, upi_suffixes: Sequence[str]) -> Column:
    suffixes = frozenset(s.lower() for s in upi_suffixes)

    def one(text: str | None) -> dict | None:
        if text is None:
            return None
        found = [{"start": a, "end": b, "near": near, "score": score, "order": -TYPES.index(kind), "type": kind} for kind, a, b, score, near in candidates(text, suffixes)]
        return {"found": found, "harmless": [{"start": a, "end": b} for a, b in harmless(text)] if found else []}

    @F.arrow_udf(_CANDIDATES)
    def scan(texts: pa.Array) -> pa.Array:
        return pa.array([one(t) for t in texts.to_pylist()], _ARROW)

    return scan(text)


def _let(value: Column, then) -> Column:
    """`then` of a value that is worked out once."""
    return F.transform(F.array(value), then)[0]


def _standing(found: Column, harmless: Column) -> Column:
    """The best of each span; of these what is in no harmless span and in no larger finding; by place."""
    rank = lambda x: F.struct(x["near"], x["score"], x["order"])
    same = lambda x, y: (x["start"] == y["start"]) & (x["end"] == y["end"])
    inside = lambda x, y: (y["start"] <= x["start"]) & (x["end"] <= y["end"])
    best = F.filter(found, lambda x: ~F.exists(found, lambda y: same(x, y) & (rank(y) > rank(x))) & ~F.exists(harmless, lambda h: inside(x, h)))
    return _let(best, lambda b: F.array_sort(F.array_distinct(F.filter(b, lambda x: ~F.exists(b, lambda y: inside(x, y) & ~same(x, y))))))


def may_hold(text: Column) -> Column:
    """Whether a text has what every identifier needs: a digit, or an @."""
    return text.rlike(r"[\p{Nd}@＠]")


def _found(text: Column, upi_suffixes: Sequence[str]) -> Column:
    return _let(_candidates(F.when(may_hold(text), text), upi_suffixes), lambda c: _standing(c["found"], c["harmless"]))


def detect(text: Column, upi_suffixes: Sequence[str] = UPI_SUFFIXES) -> Column:
    """array of struct(type, start, end, score) by place; null text: null."""
    findings = F.transform(_found(text, upi_suffixes), lambda x: F.struct(x["type"], x["start"], x["end"], x["score"]))
    return F.when(may_hold(text), findings).otherwise(F.when(text.isNotNull(), F.array().cast(FINDINGS)))


def _merged(found: Column) -> Column:
    """Overlapping findings as one: with the type of the best score, then of the longest."""
    empty = F.array().cast("array<struct<start:int,end:int,best:struct<score:double,length:int,order:int,type:string>>>")
    one = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.struct(x["score"].alias("score"), (x["end"] - x["start"]).alias("length"), x["order"].alias("order"), x["type"].alias("type")).alias("best"))

    def add(done: Column, x: Column) -> Column:
        last, new = F.element_at(done, -1), one(x)
        both = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), F.greatest(last["best"], new["best"]).alias("best"))
        overlap = (F.size(done) > 0) & (x["start"] < F.try_element_at(done, F.lit(-1))["end"])
        return F.when(overlap, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(both))).otherwise(F.concat(done, F.array(new)))

    return F.aggregate(found, empty, add)


def mask(text: Column, upi_suffixes: Sequence[str] = UPI_SUFFIXES) -> Column:
    """The text with each finding, or overlapping ones together, as [TYPE]."""

    def masked(m: Column) -> Column:
        since = lambda i: F.when(i > 0, F.get(m, i - 1)["end"]).otherwise(0)
        parts = F.transform(m, lambda x, i: F.concat(F.substring(text, since(i) + 1, x["start"] - since(i)), F.lit("["), x["best"]["type"], F.lit("]")))
        return F.concat(F.array_join(parts, ""), F.substring(text, since(F.size(m)) + 1, F.char_length(text)))

    return F.when(may_hold(text), _let(_merged(_found(text, upi_suffixes)), masked)).otherwise(text)
