"""Figures in text: a reader for each sort of figure finds them, Columns work out value, unit, kind and precision.

A text is walked from one place of interest to the next (a digit, a sign or bracket, a word that can open a figure). There
the readers for that first character are asked in turn; each is a small function over words and numerals and says where its
figure ends. Texts without an ASCII digit are never walked. All arithmetic on what is found is built-in Column functions.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .calc import scale_factor

# The words that name units, currencies, scales, months, periods and places in a document.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
CURRENCIES = {"₹": "INR", "rs": "INR", "inr": "INR", "rupee": "INR", "rupees": "INR", "$": "USD", "us$": "USD", "usd": "USD", "dollar": "USD", "dollars": "USD", "€": "EUR", "eur": "EUR", "euro": "EUR", "euros": "EUR"}
UNITS = {"%": "PCT", "percent": "PCT", "per cent": "PCT", "pct": "PCT", "bps": "BPS", "bp": "BPS", "basis point": "BPS", "basis points": "BPS", "x": "MULTIPLE", "times": "MULTIPLE"}
SCALES = {"lakh", "lakhs", "lac", "lacs", "crore", "crores", "cr", "mn", "million", "millions", "bn", "billion", "billions", "thousand", "thousands", "trillion", "trillions", "tn", "lakh crore", "lakh crores", "lakhs crore", "lakhs crores"}
GLUED = {"mm", "k", "m", "b"}
PLACES = {"page", "pages", "pg", "pgs", "slide", "slides", "section", "sections", "sec", "§", "§§", "clause", "clauses", "para", "paras", "paragraph", "paragraphs"}
PLACES_APART = {"p", "pp"}
DIGITS = "0123456789"
DASHES = "-‐‑‒–—―−"
MINUSES = "-−–"
BULLETS = "-*+•"

_month = {name[:n]: i for i, name in enumerate(MONTHS, 1) for n in range(3, len(name) + 1) if n in (3, len(name)) or name[:n] == "sept"}
_digits, _letters, _space = re.compile("[0-9]+"), re.compile(r"[^\W\d_]+"), re.compile(r"\s?")
_decimal, _rest = re.compile(r"[0-9]+(?:\.[0-9]+)?"), re.compile(r"[\w.,]*\w")
_figure_end = re.compile(r"[A-Za-z0-9_]")
#: Parts of a year by letter, and how many there are.
PARTS = {"q": 4, "h": 2}
#: Digit groups of a number that are followed; with more it is none (38 digits is the most a value has).
GROUPS = 24
#: A range of cells as a spreadsheet names it: a sheet has 31 characters at most, none of []:*?/ or a backslash.
_cell = r"\$?[a-z]{1,3}\$?[0-9]+"
_sheet = r"'[^'\[\]:*?/\\\n]{1,31}'|\w{1,31}"
_cells = re.compile(rf"(?i)(?:{_sheet})!{_cell}(?::{_cell})?|{_cell}:{_cell}")

FIELDS = ("kind", "start", "stop", "raw", "number", "scale", "currency", "unit", "minus", "paren", "year", "month", "day", "year_end", "is_range")
KINDS_OF_FIELDS = ("string", "int", "int", *["string"] * 5, "boolean", "boolean", *["int"] * 4, "boolean")
FOUND = T.ArrayType(T.StructType([T.StructField(n, {"string": T.StringType(), "int": T.IntegerType(), "boolean": T.BooleanType()}[k]) for n, k in zip(FIELDS, KINDS_OF_FIELDS)]))


def _found(text: str, kind: str, start: int, stop: int, **more) -> tuple:
    of = {"kind": kind, "start": start, "stop": stop, "raw": text[start:stop], "minus": False, "paren": False, "is_range": False} | more
    return tuple(of.get(f) for f in FIELDS)


# -- parts of figures: each takes a text and a place and returns what it read and where that ends, or nothing


def _run(text: str, at: int, pattern: re.Pattern = _digits) -> tuple[str, int]:
    m = pattern.match(text, at)
    return (m[0], m.end()) if m else ("", at)


def _after_space(text: str, at: int) -> int:
    return _space.match(text, at).end()


def _past(text: str, at: int, marks: str = "") -> int:
    """The place behind white space and these marks."""
    while text[at : at + 1] and (text[at].isspace() or text[at] in marks):
        at += 1
    return at


def _groups(text: str, first: int, end: int) -> int | None:
    """Where the digit groups end that follow a number's first digits: thousands, or Indian pairs before the last three.

    None if three more digits follow that fit neither, or groups without end: then it isn't a number.
    """

    def group(at: int) -> tuple[int, int]:
        digits, stop = _run(text, at + 1) if text[at : at + 1] == "," else ("", at)
        return len(digits), stop

    size, stop = group(end)
    followed, place = 0, end
    while size == 2 and first <= 2 and followed < GROUPS:
        followed, place = followed + 1, stop
        size, stop = group(place)
    if followed and size == 3:
        end = stop
    while not followed and size == 3 and first <= 3 and end - place < 4 * GROUPS:
        end = stop
        size, stop = group(end)
    return None if followed == GROUPS or group(end)[0] == 3 else end


def _numeral(text: str, at: int) -> tuple[str, int]:
    """A number as written; none where it is part of a longer dotted one, such as a version."""
    head, end = _run(text, at)
    if head and (end := _groups(text, len(head), end)) is None:
        return "", at
    if text[end : end + 1] == "." and (more := _run(text, end + 1))[0]:
        end = more[1]
        if text[end : end + 1] == "." and _run(text, end + 1)[0]:
            return "", at
    return text[at:end], end


def _year_part(text: str, at: int) -> tuple[str, int]:
    """Q1 to Q4, H1 and H2, either way round."""
    two = text[at : at + 2].lower()
    for letter, digit in (two, two[::-1]) if len(two) == 2 else ():
        if "1" <= digit <= str(PARTS.get(letter, 0)):
            return text[at : at + 2], at + 2
    return "", at


def _word(text: str, at: int) -> tuple[str, int]:
    word, end = _run(text, at, _letters)
    return word.lower(), end


def _year(text: str, at: int, short: bool = False) -> tuple[int | None, int]:
    """1900 to 2099, or with `short` two digits of this century."""
    digits, end = _run(text, at)
    if len(digits) == 4 and digits[:2] in ("19", "20"):
        return int(digits), end
    return (2000 + int(digits), end) if short and len(digits) == 2 else (None, at)


def _dash(text: str, at: int, others: str = "", words: tuple[str, ...] = ()) -> int | None:
    """The place after a dash or one of the others, with a space on either side."""
    at = _after_space(text, at)
    if text[at : at + 1] and text[at] in DASHES + others:
        return _after_space(text, at + 1)
    word, end = _word(text, at)
    return _after_space(text, end) if word and word in words else None


def _month_name(text: str, at: int) -> tuple[int | None, int]:
    word, end = _word(text, at)
    month = _month.get(word)
    return (month, end + (text[end : end + 1] == "." and len(word) < 5)) if month else (None, at)


# -- readers: (what was found, where to go on), or None


def _range_end(year: int, end: int | None, short: str) -> int | None:
    """The later year of two; None if the second is not later."""
    if end is None and len(short) == 2:
        end = year // 100 * 100 + int(short)
    return end if end is not None and end > year else None


def _dated(text: str, start: int, stop: int, year: int, month: int, day: int, **more) -> tuple[list[tuple], int]:
    """A date; one that no calendar has is read again as its numbers."""
    try:
        datetime.date(year, month, day or 1)
    except ValueError:
        return [_found(text, "amount", m.start() + start, m.end() + start, number=m[0]) for m in _digits.finditer(text[start:stop])], stop
    return [_found(text, "date", start, stop, year=year, month=month, day=day, **more)], stop


def _closed(text: str, stop: int) -> bool:
    return not _figure_end.match(text, stop)


def _read_marker(text: str, at: int):
    digits, end = _run(text, at)
    if len(digits) > 2 or text[end : end + 1] not in (".", ")") or text[end + 1 : end + 2] not in (" ", "\t"):
        return None
    line = text[text.rfind("\n", 0, at) + 1 : at].strip(" \t")
    if line[:1] and line[0] in BULLETS and (line[1:2] in (" ", "\t") or len(line) == 1 and text[at - 1] in " \t"):
        line = line[1:].strip(" \t")
    return ([_found(text, "list_marker", at, end, number=digits)], end + 1) if line in ("", "(") else None


def _read_footnote(text: str, at: int):
    digits, end = _run(text, at + 1)
    first = digits
    while digits and len(digits) <= 3:
        if text[end : end + 1] == "]":
            return [_found(text, "locator", at, end + 1, number=first)], end + 1
        end = _dash(text, end, ",")
        digits, end = _run(text, end) if end is not None else ("", 0)
    return None


def _read_link(text: str, at: int):
    word, end = _word(text, at)
    if word == "cite" and text[end : end + 1] == ":" or word in ("http", "https") and text.startswith("://", end) or word == "www" and text[end : end + 1] == ".":
        while end < len(text) and not text[end].isspace() and text[end] not in ")]>":
            end += 1
        return [], end
    return None


def _read_place(text: str, at: int):
    """page 12, pp. 12-14, sections 2 and 4, clause 3.2a"""
    word, end = _word(text, at)
    while text[end : end + 1] == "§":
        word, end = word + "§", end + 1
    if word not in PLACES and word not in PLACES_APART:
        return None
    dot = text[end : end + 1] == "."
    end += dot
    apart = _after_space(text, end)
    if word in PLACES_APART and not dot and apart == end:
        return None

    def one(at: int) -> int | None:
        digits, end = _run(text, at)
        while digits and text[end : end + 1] == "." and (more := _run(text, end + 1))[0]:
            end = more[1]
        if digits and (letter := _word(text, end))[0] and len(letter[0]) == 1:
            end = letter[1]
        return end if digits and _closed(text, end) else None

    first, stop = apart, one(apart)
    if stop is None:
        return None
    while (after := _dash(text, stop, ",&", ("and", "to"))) is not None and (more := one(after)) is not None:
        stop = more
    return [_found(text, "locator", at, stop, number=_run(text, first, _decimal)[0])], stop


def _read_cells(text: str, at: int):
    m = _cells.match(text, at)
    if not m or not _closed(text, m.end()):
        return None
    digits = _digits.search(m[0])
    return [_found(text, "cell", at, m.end(), number=digits[0])], m.end()


def _read_period(text: str, at: int):
    """Q2 FY26, H1FY26, FY25-26, FY26E, Q3 2025, H1"""
    part, end = _year_part(text, at)
    if not part and "1" <= text[at : at + 1] <= "9" and text[at + 1 : at + 2] in ("m", "M"):
        end = at + 2  # so many months of a year
    after = _after_space(text, end)
    fiscal = text[after : after + 2].lower() in ("fy", "cy")
    if not fiscal:
        if not part:
            return None
        mark = after + (text[after : after + 1] in ("'", "’"))
        year, stop = _year(text, mark, short=mark > after or after == end)
        return ([_found(text, "period", at, stop if year else end, year=year)], stop if year else end) if _closed(text, stop if year else end) else None
    mark = _after_space(text, after + 2)
    year, stop = _year(text, mark + (text[mark : mark + 1] in ("'", "’")), short=True)
    if year is None:
        return None
    last = None
    if (second := _dash(text, stop, "/")) is not None:
        second += 2 * (text[second : second + 2].lower() in ("fy", "cy"))
        last, behind = _year(text, second + (text[second : second + 1] in ("'", "’")), short=True)
        stop = behind if last else stop
    if text[stop : stop + 1].lower() in tuple("eapf") and _closed(text, stop + 1):
        stop += 1
    return ([_found(text, "period", at, stop, year=year, year_end=last)], stop) if _closed(text, stop) else None


def _read_month(text: str, at: int):
    """March 31, 2025; March 2025; Mar-25; Mar '25"""
    month, end = _month_name(text, at)
    if not month:
        return None
    after = _after_space(text, end)
    digits, behind = _run(text, after)
    if 0 < len(digits) <= 2 and 1 <= int(digits) <= 31:
        suffix, behind = (text[behind : behind + 2].lower(), behind + 2) if text[behind : behind + 2].lower() in ("st", "nd", "rd", "th") else ("", behind)
        comma = behind + (text[behind : behind + 1] == ",")
        gap = _past(text, comma)
        year, stop = _year(text, gap)
        if year and gap > comma and not _run(text, stop)[0]:
            return _dated(text, at, stop, year, month, int(digits))
    gap = _past(text, end, ",")
    year, stop = _year(text, gap)
    if year is None or gap == end:
        mark = _dash(text, end)
        if mark is None and text[after : after + 1] in ("'", "’"):
            mark = _after_space(text, after + 1)
        year, stop = _year(text, mark, short=True) if mark is not None else (None, at)
    return _dated(text, at, stop, year, month, 0) if year and _closed(text, stop) else None


def _read_numeric_date(text: str, at: int):
    """2025-03-31, 31/03/2025, 31.03.25, 2025-03, 2011-12, 2023-2026"""
    if at and text[at - 1] in ".,/-":
        return None
    first, end = _run(text, at)
    sep = text[end : end + 1]
    second, end2 = _run(text, end + 1) if sep and sep in "/.-" else ("", end)
    year, _ = _year(text, at)
    third, end3 = _run(text, end2 + 1) if second and text[end2 : end2 + 1] == sep else ("", end2)
    if year and sep == "-" and len(second) == 2 and len(third) == 2:
        return _dated(text, at, end3, year, int(second), int(third))
    if not year and 0 < len(first) <= 2 and 0 < len(second) <= 2 and len(third) in (2, 4) and not (text[end3 : end3 + 1] in tuple("/.-") and _run(text, end3 + 1)[0]):
        whole, _ = _year(text, end2 + 1, short=True)
        if whole and _closed(text, end3):
            day, month = int(first), int(second)
            return _dated(text, at, end3, whole, *((day, month) if month > 12 >= day else (month, day)))
    if year:
        after = _dash(text, end, "/", ("to",))
        later, stop = _year(text, after) if after is not None else (None, end)
        short, behind = _run(text, after) if after is not None else ("", end)
        stop = stop if later else behind
        if (later or len(short) == 2) and _closed(text, stop) and not (text[stop : stop + 1] in ("-", "/") and _run(text, stop + 1)[0]):
            if last := _range_end(year, later, short):
                return [_found(text, "period", at, stop, year=year, year_end=last)], stop
            if not later and sep == "-" and 1 <= int(short) <= 12:
                return _dated(text, at, stop, year, int(short), 0)
    return None


def _read_day_month(text: str, at: int):
    """31 March 2025, 6th Oct 2026, 06-Oct-26"""
    digits, end = _run(text, at)
    if len(digits) > 2 or at and text[at - 1] in ".,":
        return None
    if text[end : end + 2].lower() in ("st", "nd", "rd", "th"):
        end += 2
    month, stop = _month_name(text, _past(text, end, "-/."))
    if not month:
        return None
    year, behind = _year(text, _past(text, stop, "-/.,"))
    if not year and (text[stop : stop + 1] in tuple("-/.'’")):
        year, behind = _year(text, stop + 1, short=True)
    return _dated(text, at, behind, year, month, int(digits)) if year and _closed(text, behind) else None


def _read_count(text: str, at: int):
    """5-year, 3Y, 3rd"""
    digits, end = _run(text, at)
    if len(digits) > 4 or at and text[at - 1] in ".,":
        return None
    if text[end : end + 2].lower() in ("st", "nd", "rd", "th") and _closed(text, end + 2):
        return [_found(text, "ordinal", at, end + 2, number=digits)], end + 2
    after = _dash(text, end)
    word, stop = _word(text, after if after is not None else _after_space(text, end))
    if len(digits) <= 3 and word in ("year", "years", "yr", "yrs", "y") and _closed(text, stop):
        return [_found(text, "duration", at, stop, number=digits)], stop
    return None


def _phrase(text: str, at: int, known) -> tuple[str | None, int]:
    """The longest of one or two words in `known`."""
    word, end = _word(text, at)
    two, end2 = _word(text, _past(text, end)) if word else ("", end)
    if two and end2 > end and f"{word} {two}" in known:
        return f"{word} {two}", end2
    return (word, end) if word in known else (None, at)


def _currency(text: str, at: int) -> tuple[str | None, int]:
    word, end = _word(text, at)
    if text[end : end + 1] == "$" and word in ("", "us"):
        return "USD", end + 1
    if not word:
        return (CURRENCIES[text[at]], at + 1) if text[at : at + 1] in ("₹", "€") else (None, at)
    return (CURRENCIES[word], end + (word == "rs" and text[end : end + 1] == ".")) if word in ("rs", "inr", "usd", "eur") else (None, at)


def _read_amount(text: str, at: int):
    """Sign, currency, numeral or range of two, scale, currency and unit; brackets around it all."""
    currency, end = _currency(text, at)
    end = _after_space(text, end) if currency else end
    inner = currency is not None and text[end : end + 1] in tuple("-−")
    first, stop = _numeral(text, end + inner)
    if not first:
        return None
    number_at, number_end = end + inner, stop
    before = text[at - 1 : at] if at else ""
    minus = inner
    start = at
    if before and before in MINUSES and not (at > 1 and (text[at - 2].isalnum() or text[at - 2] == "_")):
        minus, start = True, at - 1
    elif before and before in DASHES and at > 1 and text[at - 2].isalpha():
        return [], stop
    second = None
    if (after := _dash(text, stop, "", ("to",))) is not None and (more := _numeral(text, after))[0]:
        second, stop = (after, *more), more[1]
    scale, behind = _phrase(text, _after_space(text, stop), SCALES)
    if not scale and (glued := _word(text, stop))[0] in GLUED:
        scale, behind = glued
    stop = behind if scale else stop
    word, behind = _word(text, _after_space(text, stop))
    if word in CURRENCIES and word != "rs":
        currency, stop = currency or CURRENCIES[word], behind
    apart = _after_space(text, stop)
    unit, behind = ("%", apart + 1) if text[apart : apart + 1] == "%" else _phrase(text, apart, UNITS)
    if unit and not (unit == "times" and apart == stop) and (unit == "%" or _closed(text, behind)):
        unit, stop = UNITS[unit], behind
    else:
        unit = None
    if not _closed(text, stop):
        return None
    paren = text[start - 1 : start] == "(" and start > 0 and text[stop : stop + 1] == ")" and not (unit or currency or minus)
    of = {"scale": scale, "currency": currency, "unit": unit, "is_range": second is not None}
    if second is None:
        return [_found(text, "amount", start - paren, stop + paren, number=first, minus=minus, paren=paren, **of)], stop
    return [
        _found(text, "amount", number_at, number_end, number=first, minus=minus, paren=paren, **of),
        _found(text, "amount", second[0], stop, number=second[1], paren=paren, **of),
    ], stop


ON_DIGIT = (_read_marker, _read_period, _read_numeric_date, _read_day_month, _read_cells, _read_count, _read_amount)
ON_WORD = {
    **dict.fromkeys(("cite", "http", "https", "www"), _read_link), **dict.fromkeys((*PLACES, *PLACES_APART), _read_place), **dict.fromkeys(_month, _read_month),
    **dict.fromkeys(("q", "h", "fy", "cy"), _read_period), **dict.fromkeys(("us", "rs", "inr", "usd", "eur"), _read_amount),
}
ON_SIGN = {"[": _read_footnote, "'": _read_cells, "§": _read_place}


def _openings() -> str:
    """Words that may be in ON_WORD, by their first two letters, and words right before what may go on as a cell."""
    both = lambda c: c + c.upper()
    words = [w for w in ON_WORD if w.isalpha()]
    firsts = sorted({w[0] for w in words if len(w) > 1})
    longer = "|".join(f"[{both(c)}][{''.join(both(x) for x in sorted({w[1] for w in words if w[0] == c and len(w) > 1}))}]" for c in firsts)
    alone = "".join(both(w) for w in words if len(w) == 1)
    letter = r"[^\W\d_]"
    return rf"(?<!{letter})(?:{letter}++(?=[!$\w])|(?:{longer}){letter}*+|[{alone}](?!{letter}))"


#: A digit, a word that may open a figure, a sign. Other words are never looked at one by one.
_interest = re.compile(rf"[0-9]|[\['§₹$€]|\.(?=[0-9])|{_openings()}")


def scan(text: str) -> Iterator[tuple]:
    """What the readers find, in order, as written: nothing is calculated here but which day and month are meant."""
    at = 0
    while m := _interest.search(text, at):
        start, first = m.start(), m[0]
        if start and (text[start - 1].isalnum() or text[start - 1] == "_") and first not in ("[", "'"):
            at = m.end() if first not in DIGITS else _digits.match(text, start).end()
            continue
        if first.isdigit() and text[max(start - 2, 0) : start][:1].isdigit() and text[start - 1] == ".":
            at = _rest.match(text, start).end()  # behind a digit and a dot: a version's part
            continue
        if first.isdigit():
            readers = ON_DIGIT
        elif first[0].isalpha():
            one = ON_WORD.get(first.lower())
            after = text[m.end() : m.end() + 1]
            cells = after in ("!", "$", "_") or after.isdigit()
            readers = ((one,) if one else ()) + ((_read_cells,) if cells else ())
        else:
            readers = (ON_SIGN.get(first, _read_amount),)
        for read in readers:
            if got := read(text, start):
                yield from got[0]
                at = got[1]
                break
        else:
            at = m.end()
            if first.isdigit():  # a number that is none: the rest of it is none either
                at = _rest.match(text, start).end()


#: What a worker remembers of texts: their characters and MARK for each figure in them; characters of a text that is remembered.
REMEMBERED, MARK, SHORT = 1 << 22, 64, 1 << 12
_known: dict[str, list[tuple]] = {}
_held = 0


def _read(text: str) -> list[tuple]:
    """What scan finds; texts that come again are not read again."""
    global _held
    found = _known.get(text)
    if found is None:
        found = list(scan(text))
        if len(text) <= SHORT:
            if _held > REMEMBERED:
                _known.clear()
                _held = 0
            _known[text] = found
            _held += len(text) + MARK * len(found)
    return found


@F.arrow_udf(FOUND)
def find_figures(texts: pa.Array) -> pa.Array:
    """Equal texts of a batch are read once."""
    arrow = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    once = texts.dictionary_encode()
    rows, ends = [], [0]
    for t in once.dictionary.to_pylist():
        rows += _read(t)
        ends.append(len(rows))
    columns = zip(*rows) if rows else [()] * len(FIELDS)
    found = pa.StructArray.from_arrays([pa.array(c, arrow[k]) for c, k in zip(columns, KINDS_OF_FIELDS)], FIELDS)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found).take(once.indices)


DECIMAL = "decimal(38,10)"


def figures(text: Column) -> Column:
    """array of struct(kind, start, stop, raw, value, unit, step, number, signed): figures with canonical values."""
    some = text.rlike("[0-9]")
    return F.when(some, F.transform(find_figures(F.when(some, text)), _figure)).when(text.isNotNull(), F.filter(F.transform(find_figures(F.lit("")), _figure), lambda x: F.lit(False)))


def each(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """keep and the fields of `figures`, one row per figure: what is calculated stands outside of any lambda, so Spark compiles it."""
    some = F.col(text).rlike("[0-9]")
    rows = df.select(*keep, F.explode(F.when(some, find_figures(F.when(some, F.col(text))))).alias("_x"))
    return rows.select(*keep, _figure(F.col("_x")).alias("_f")).select(*keep, "_f.*")


def _figure(x: Column) -> Column:
    plain = F.replace(x["number"], F.lit(","), F.lit(""))
    decimals = F.when(F.contains(plain, F.lit(".")), F.char_length(plain) - F.instr(plain, ".")).otherwise(0)
    negative = x["minus"] | x["paren"]
    number = plain.try_cast(DECIMAL) * F.when(negative, -1).otherwise(1)
    factor = scale_factor(x["scale"])
    year = (x["kind"] == "amount") & ~x["is_range"] & x["scale"].isNull() & x["unit"].isNull() & x["currency"].isNull() & ~negative & plain.rlike("^(?:19|20)[0-9]{2}$") & (x["number"] == plain)
    period, date = x["kind"] == "period", x["kind"] == "date"
    code = F.coalesce(F.when(period, F.coalesce(x["year_end"], x["year"])).otherwise(x["year"]), F.lit(0)) * 10000 + F.coalesce(x["month"], F.lit(0)) * 100 + F.coalesce(x["day"], F.lit(0))
    unit = (
        F.when(date | period | year, "DATE").when(x["unit"].isNotNull(), x["unit"]).when(x["currency"].isNotNull(), x["currency"])
        .when(x["kind"].isin("duration", "ordinal", "list_marker"), "COUNT")
        .when((x["kind"] == "amount") & x["scale"].isNull() & (decimals == 0) & ~negative, "COUNT").otherwise("PLAIN")
    )
    value = F.when(date | period, code.cast(DECIMAL)).when(year, (number * 10000).cast(DECIMAL)).otherwise((number * factor).cast(DECIMAL))
    kind = F.when(year, "year").when(x["kind"] == "duration", "period").when(x["kind"] == "amount", "number").when(x["kind"] == "cell", "locator").otherwise(x["kind"])
    step = F.when(unit == "DATE", F.lit(1).cast(DECIMAL)).otherwise((F.pow(F.lit(10.0), -decimals) * factor).cast(DECIMAL))
    return F.struct(
        kind.alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), x["raw"].alias("raw"), value.cast(DECIMAL).alias("value"), unit.alias("unit"),
        step.alias("step"), number.cast(DECIMAL).alias("number"), x["minus"].alias("signed"),
    )


def dimension(unit: Column) -> Column:
    """What may be compared: each currency, ratios, numbers, dates and multiples by themselves."""
    return F.when(unit.isin("INR", "USD", "EUR"), F.concat(F.lit("MONEY:"), unit)).when(unit.isin("PCT", "BPS"), "RATIO").when(unit.isin("COUNT", "PLAIN"), "NUMBER").otherwise(unit)


def key(unit: Column, value: Column) -> Column:
    """Basis points compare as percent."""
    return F.when(unit == "BPS", value / 100).otherwise(value)


# Words that make a year next to them a period, before and behind it, and how far away they may stand.
PERIOD_BEFORE, PERIOD_BEHIND = ("fiscal", "calendar", "fy", "cy", "year"), ("fiscal", "fy", "cy", "financial year", "calendar year")
NEAR = 24
#: A link to a source: [words](cite:place).
CITED = r"\[[^\[\]\n]*\]\(cite:[^()\s]*\)"


def is_exempt(figure: Column | dict[str, Column], text: Column | None = None, spans: Column | None = None) -> Column:
    """Labels, places in documents and small counts need no source; in its text, nor do years of a period phrase and what a link to a source holds.

    spans: the text's cited_spans, where they are known.
    """
    small = (figure["value"] >= 0) & (figure["value"] <= 12)
    out = figure["kind"].isin("period", "locator", "list_marker") | (figure["kind"].isin("ordinal") & small) | ((figure["kind"] == "number") & (figure["unit"] == "COUNT") & small)
    if text is None:
        return out
    return out | ((figure["kind"] == "year") & in_period_phrase(text, figure["start"], figure["stop"])) | inside_any(cited_spans(text) if spans is None else spans, figure["start"], figure["stop"])


def in_period_phrase(text: Column, start: Column, stop: Column) -> Column:
    """fiscal 2025, calendar year 2024, 2025 financial year: the last word before a place, or the first ones behind it."""
    begin = F.greatest(start - NEAR, F.lit(0))
    before = F.rtrim(F.lower(F.substring(text, begin + 1, start - begin)), F.lit(" \t\n\r\u00a0:'\u2019"))
    behind = F.split(F.ltrim(F.lower(F.substring(text, stop + 1, F.lit(NEAR)))), "[^a-z]+", 3)
    one, two = F.get(behind, F.lit(0)), F.concat_ws(" ", F.get(behind, F.lit(0)), F.get(behind, F.lit(1)))
    return F.regexp_extract(before, "([a-z]+)$", 1).isin(*PERIOD_BEFORE) | one.isin(*PERIOD_BEHIND) | two.isin(*PERIOD_BEHIND)


def cited_spans(text: Column) -> Column:
    """array of struct(lo, hi): where links to sources stand."""
    links, pieces = F.regexp_extract_all(text, F.lit(CITED), F.lit(0)), F.split(text, CITED, -1)
    sizes = F.zip_with(pieces, links, lambda p, x: F.struct(F.char_length(p).alias("gap"), F.char_length(x).alias("link")))
    none = F.array().cast("array<struct<lo:int,hi:int>>")
    step = lambda done, x: F.concat(done, F.array(F.struct((_last(done) + x["gap"]).cast("int").alias("lo"), (_last(done) + x["gap"] + x["link"]).cast("int").alias("hi"))))
    return F.when(F.contains(text, F.lit("](cite:")), F.aggregate(F.filter(sizes, lambda x: x["link"].isNotNull()), none, step)).otherwise(none)


def _last(spans: Column) -> Column:
    return F.coalesce(F.try_element_at(spans, F.lit(-1))["hi"], F.lit(0))


def inside_any(spans: Column, start: Column, stop: Column) -> Column:
    return F.exists(spans, lambda s: (s["lo"] <= start) & (stop <= s["hi"]))
