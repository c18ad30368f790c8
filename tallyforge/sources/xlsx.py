"""Workbooks as tables: a Python data source that turns XLSX files into one row per cell.

Each file is one partition, read on an executor from bytes that Spark's binaryFile source delivers, so any store Spark can
read will do. A file that can't be read gives one row with an error instead of failing the job.
"""

from __future__ import annotations

import datetime
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: kind is text, number, boolean, date, duration (number: seconds), error, blank (a formula without a value) or comment (with an author).
CELLS = "path string, sheet string, hidden boolean, row int, col int, ref string, kind string, text string, number double, formula boolean, error string"
WORKBOOK = CELLS + ", author string"
_FIELDS = ("path", "sheet", "hidden", "row", "col", "ref", "kind", "text", "number", "formula", "error", "author")
_TYPES = (pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.bool_(), pa.string(), pa.string())
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Built-in number formats that show dates.
DATE_FORMATS = frozenset((*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)))
DURATION = 46
MOST_SHEETS, MOST_ROWS, MOST_PART = 50, 500_000, 64 << 20


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(z.read(name))


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


def _letters(col: int) -> str:
    out = ""
    while col:
        col, k = divmod(col - 1, 26)
        out = chr(65 + k) + out
    return out


def _styles(z: zipfile.ZipFile) -> dict[int, str]:
    """Places of the cell styles that show dates or durations (hours, minutes or seconds in brackets)."""
    if "xl/styles.xml" not in z.namelist():
        return {}
    styles = _xml(z, "xl/styles.xml")
    shows = dict.fromkeys(DATE_FORMATS, "date") | {DURATION: "duration"}
    for f in styles.iter(f"{_MAIN}numFmt"):
        code = re.sub(r'"[^"]*"', "", f.get("formatCode", "")).lower()
        shown = "duration" if re.search(r"\[(h+|m+|s+)\]", code) else "date" if re.search("[dyhs]", re.sub(r"\[[^\]]*\]", "", code)) else None
        shows[int(f.get("numFmtId"))] = shown
    formats = styles.find(f"{_MAIN}cellXfs")
    kinds = {i: shows.get(int(x.get("numFmtId", 0))) for i, x in enumerate(formats if formats is not None else ())}
    return {i: k for i, k in kinds.items() if k}


def _value(c: ElementTree.Element, shared: list[str], styles: dict[int, str]) -> tuple | None:
    """kind, text, number and formula of a cell; None if it is empty."""
    kind, v, inline = c.get("t", "n"), c.find(f"{_MAIN}v"), c.find(f"{_MAIN}is")
    raw = "".join(t.text or "" for t in inline.iter(f"{_MAIN}t")) if inline is not None else v.text if v is not None else None
    formula = c.find(f"{_MAIN}f") is not None
    shows = styles.get(int(c.get("s", 0))) if kind == "n" else None
    if raw is None:
        return ("blank", None, None, True) if formula else None
    if kind == "s":
        return "text", shared[int(raw)], None, formula
    if kind == "b":
        return "boolean", "true" if raw == "1" else "false", None, formula
    if shows == "duration":
        return "duration", None, round(float(raw) * 86_400, 6), formula
    if shows == "date":
        day = datetime.datetime(1899, 12, 30) + datetime.timedelta(days=float(raw))
        return "date", day.date().isoformat() if float(raw).is_integer() else day.isoformat(timespec="seconds"), None, formula
    return ("number", None, float(raw), formula) if kind == "n" else ("error" if kind == "e" else "text", raw, None, formula)


def _relations(z: zipfile.ZipFile, part: str) -> list[tuple[str, str, str]]:
    """Id, kind and target of a part's relations."""
    folder, name = posixpath.split(part)
    where = f"{folder}/_rels/{name}.rels"
    if where not in z.namelist():
        return []
    target = lambda t: posixpath.normpath(t.lstrip("/") if t.startswith("/") else posixpath.join(folder, t))
    return [(r.get("Id"), r.get("Type", "").rsplit("/", 1)[-1], target(r.get("Target", ""))) for r in _xml(z, where)]


def _comments(z: zipfile.ZipFile, part: str) -> Iterator[tuple[str, str, str | None]]:
    """Place, text and author of a sheet's comments."""
    for _, kind, target in _relations(z, part):
        if kind != "comments" or target not in z.namelist():
            continue
        if z.getinfo(target).file_size > MOST_PART:
            raise ValueError(f"a part of more than {MOST_PART} bytes")
        comments = _xml(z, target)
        authors = [a.text or None for a in comments.iterfind(f"{_MAIN}authors/{_MAIN}author")]
        for c in comments.iterfind(f"{_MAIN}commentList/{_MAIN}comment"):
            number = c.get("authorId", "")
            yield c.get("ref", ""), "".join(t.text or "" for t in c.iter(f"{_MAIN}t")), authors[int(number)] if number.isdigit() and int(number) < len(authors) else None


def cells(path: str, content: bytes, area: tuple | None = None) -> Iterator[tuple]:
    """Cached values and comments; empty cells are left out; dates become ISO text.

    area: (sheet or None for the first, first column and row, last column and row); nothing else is taken from the file: other sheets stay
    closed, cells beside it are not evaluated, and reading stops behind its last row.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        book, styles = _xml(z, "xl/workbook.xml"), _styles(z)
        targets = {i: t for i, _, t in _relations(z, "xl/workbook.xml")}
        shared = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in _xml(z, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else []
        sheets = list(book.iter(f"{_MAIN}sheet"))
        if len(sheets) > MOST_SHEETS:
            raise ValueError(f"more than {MOST_SHEETS} sheets")
        named, c0, r0, c1, r1 = area or (None, 1, 1, 1 << 20, 1 << 30)
        for k, sheet in enumerate(sheets):
            name, hidden, part = sheet.get("name"), sheet.get("state", "visible") != "visible", targets[sheet.get(_REL)]
            if area and (name != named if named else k):
                continue
            row = col = 0
            with z.open(part) as f:
                for event, c in ElementTree.iterparse(f, ("start", "end")):
                    if event == "start" and c.tag == f"{_MAIN}row":
                        row, col = int(c.get("r", row + 1)), 0
                        if row > r1:
                            break
                    elif event == "end" and c.tag == f"{_MAIN}c":
                        col = _column(c.get("r")) if c.get("r") else col + 1
                        if r0 <= row and c0 <= col <= c1 and (value := _value(c, shared, styles)):
                            yield path, name, hidden, row, col, f"{_letters(col)}{row}", *value, None, None
                    elif event == "end" and c.tag == f"{_MAIN}row":
                        c.clear()
            for ref, text, author in _comments(z, part):
                row, col = int(re.search("[0-9]+|$", ref)[0] or 0), _column(ref) if re.match("[A-Z]", ref) else 0
                if r0 <= row <= r1 and c0 <= col <= c1 or not area:
                    yield path, name, hidden, row, col, ref, "comment", text, None, False, None, author


def _read(area: tuple | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                try:
                    for row in cells(path, content.as_py(), area):
                        rows.append(row)
                        if len(rows) == 10_000:
                            yield _batch(rows)
                            rows = []
                except (KeyError, ValueError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows.append((path, *[None] * 9, f"{type(e).__name__}", None))
                yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], list(_FIELDS))


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """One row per cell and per comment of every workbook under path, from one pass over each file: see cells_of and comments_of."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_read(None), WORKBOOK)


def cells_of(workbooks: DataFrame) -> DataFrame:
    return workbooks.where("kind is null or kind <> 'comment'").drop("author")


def comments_of(workbooks: DataFrame) -> DataFrame:
    """path, sheet, row, col, ref, text, author (null where the file names none)."""
    return workbooks.where("kind = 'comment'").select("path", "sheet", "row", "col", "ref", "text", "author")


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """One row per non-empty cell of every workbook under path."""
    return cells_of(read_workbooks(spark, path))


def read_range(spark: SparkSession, path: str, area: str) -> DataFrame:
    """The cells and comments of a range like Sheet!B2:D9 (without a sheet: of the first one) of every workbook under path."""
    shape = re.fullmatch(r"(?:'((?:[^']|'')+)'!|([^'!]+)!)?\$?([A-Z]+)\$?([0-9]+)(?::\$?([A-Z]+)\$?([0-9]+))?", area)
    if not shape:
        raise ValueError(f"not a range: {area}")
    quoted, plain, c0, r0, c1, r1 = shape.groups()
    box = sorted((_column(c0), _column(c1 or c0))), sorted((int(r0), int(r1 or r0)))
    taken = (quoted.replace("''", "'") if quoted else plain, box[0][0], box[1][0], box[0][1], box[1][1])
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_read(taken), WORKBOOK)


def sheet_rows(df: DataFrame) -> DataFrame:
    """path, sheet, row, values: cells by column, nulls where one is missing, none after the last."""
    value = F.coalesce("text", F.col("number").cast("string"))
    by = df.where("error IS NULL AND kind <> 'blank'").groupBy("path", "sheet", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", value))).alias("m"))
    return by.select("path", "sheet", "row", F.transform(F.sequence(F.lit(1), F.array_max(F.map_keys("m"))), lambda i: F.try_element_at("m", i)).alias("values"))


def uncached_formulas(df: DataFrame) -> DataFrame:
    """Per sheet, formulas without a cached value."""
    cached = df.where("kind <> 'blank'").select("path", "sheet", "ref")
    return df.where("formula").join(cached, ["path", "sheet", "ref"], "left_anti").groupBy("path", "sheet").agg(F.count(F.lit(1)).alias("uncached"))


def chunk_rows(rows: DataFrame, size: int = 40) -> DataFrame:
    """Runs of so many rows of a sheet as text: path, sheet, chunk, body."""
    line = F.array_join(F.transform("values", lambda v: F.coalesce(v, F.lit(""))), "\t")
    by = rows.groupBy("path", "sheet", F.floor((F.col("row") - 1) / size).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("row", line.alias("line")))).alias("r"))
    return by.select("path", "sheet", "chunk", F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("body"))


def fill_grid(cells_with_spans: DataFrame, table: str, *also: str) -> DataFrame:
    """A document table's cells (table, row, col, row_span, col_span, text, ...) spread over the places they span."""
    kept = [table, "text", *also]
    places = cells_with_spans.select(*kept, F.col("col"), F.col("col_span"), F.explode(F.sequence("row", F.col("row") + F.col("row_span") - 1)).alias("row"))
    each = places.select(*kept, "row", F.explode(F.sequence("col", F.col("col") + F.col("col_span") - 1)).alias("col"))
    w = Window.partitionBy(table, "row", "col").orderBy("text")
    return each.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def grid_records(cells_with_spans: DataFrame, table: str) -> DataFrame:
    """Each place that isn't a header, with the headers that it stands under: table, row, col, text, above, beside.

    cells(table, row, col, row_span, col_span, text, header). above: texts of the header cells in its column, from the top; beside: of those in
    its row, from the left. A header that spans several places of a path counts once. Headers below or to the right of a cell aren't its own.
    """
    grid = fill_grid(cells_with_spans, table, "header")
    place = ["row", "col"]
    out = grid.where("not coalesce(header, false)").select(table, *place, "text")
    for along, across, name in ((*place, "above"), (*place[::-1], "beside")):
        heads = grid.where("header").groupBy(table, across).agg(F.array_sort(F.collect_list(F.struct(F.col(along).alias("at"), "text"))).alias("heads"))
        mine = F.expr(f"filter(heads, h -> h.at < `{along}`)")
        once = F.expr("filter(mine, (h, i) -> i = 0 or h.text is distinct from mine[i - 1].text)")
        path = F.coalesce(F.transform(once, lambda h: h["text"]), F.array().cast("array<string>"))
        out = out.join(heads, [table, across], "left").withColumn("mine", mine).withColumn(name, path).drop("heads", "mine")
    return out.select(table, *place, "text", "above", "beside")
