"""Result workbooks: a data source that writes XLSX from several tasks and leaves either the whole file or nothing.

    df.write.format("workbook").option("operations", json).option("notes", json).mode("append").save("/shared/out.xlsx")

Each task writes its rows as lines of sheet XML into a staging folder beside the file; the commit zips them, in the order of the
partitions, and renames; an abort deletes them. Cells have no references, so parts can follow each other. A sheet that is full goes on in
a further one. The `Operations` sheet lists the steps, the `Notes` sheet sources and the confidentiality line.
"""

from __future__ import annotations

import contextlib
import datetime
import decimal
import io
import json
import time
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Rows of a sheet with its header: what the format allows.
MOST = 1_048_576
_NOT_XML = {c: None for c in (*range(9), 11, 12, *range(14, 32), 0xFFFE, 0xFFFF)}
_SPACE = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _cell(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float, decimal.Decimal)) and value == value and abs(value) != float("inf"):
        return f"<c><v>{value!r}</v></c>" if not isinstance(value, decimal.Decimal) else f"<c><v>{value}</v></c>"
    text = value.isoformat() if isinstance(value, (datetime.date, datetime.datetime)) else str(value)
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text.translate(_NOT_XML)).replace(chr(10), "&#10;").replace(chr(13), "&#13;")}</t></is></c>'


def _row(values: Iterable) -> str:
    """One line."""
    return f"<row>{''.join(map(_cell, values))}</row>\n"


@dataclass
class Part(WriterCommitMessage):
    partition: int
    name: str
    rows: int


class WorkbookWriter(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.columns, self.overwrite = schema.names, overwrite
        self.path, self.sheet = options["path"], options.get("sheet", "Result")
        self.operations, self.notes = (json.loads(options.get(k, "[]")) for k in ("operations", "notes"))
        self.staging = f"{self.path}.{uuid.uuid4().hex}.parts"

    @staticmethod
    def _files(path: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def write(self, iterator: Iterator) -> Part:
        from pyspark import TaskContext

        store, folder = self._files(self.staging)  # made before the job, so a task that outlives an abort finds no place to write
        name, rows = uuid.uuid4().hex, 0
        with store.open_output_stream(f"{folder}/{name}") as raw, io.TextIOWrapper(raw, "utf-8", newline="\n") as out:
            for row in iterator:
                out.write(_row(row))
                rows += 1
        return Part(TaskContext.get().partitionId(), name, rows)

    def _lines(self, parts: list[Part]) -> Iterator[str]:
        store, folder = self._files(self.staging)
        for part in sorted(parts, key=lambda p: p.partition):
            with store.open_input_stream(f"{folder}/{part.name}") as raw, io.TextIOWrapper(raw, "utf-8", newline="\n") as lines:
                yield from lines

    def commit(self, messages: list) -> None:
        parts = [m for m in messages if m is not None]
        store, path = self._files(self.path)
        from pyarrow import fs

        if not self.overwrite and store.get_file_info(path).type != fs.FileType.NotFound:
            self.abort(messages)
            raise FileExistsError(self.path)
        half = f"{self._files(self.staging)[1]}/workbook"
        with store.open_output_stream(half) as raw, zipfile.ZipFile(_Counted(raw), "w", zipfile.ZIP_DEFLATED) as z:
            names = self._write_sheets(z, self._lines(parts))
            _package(z, names)
        store.move(half, path)
        self.abort(messages)

    def _write_sheets(self, z: zipfile.ZipFile, lines: Iterator[str]) -> list[str]:
        names, line = [], next(lines, None)
        while line is not None or not names:
            names.append(self.sheet if not names else f"{self.sheet} ({len(names) + 1})")
            with _sheet(z, len(names)) as out:
                out(_row(self.columns))
                rows = 1
                while line is not None and rows < MOST:
                    out(line)
                    line, rows = next(lines, None), rows + 1
        for name, header, rows in (("Operations", ("step", "operation", "parameters", "at"), _steps(self.operations)), ("Notes", ("note", "text"), [(n.get("kind"), n.get("text")) for n in self.notes])):
            names.append(name)
            with _sheet(z, len(names)) as out:
                for row in (header, *rows):
                    out(_row(row))
        return names

    def prepare(self) -> WorkbookWriter:
        store, folder = self._files(self.staging)
        store.create_dir(folder, recursive=True)
        return self

    def abort(self, messages: list) -> None:
        store, folder = self._files(self.staging)
        for wait in (0.1, 0.5, 2.0):
            try:
                return store.delete_dir(folder)
            except FileNotFoundError:
                return None
            except OSError:  # a task that is being killed has just made a file in it
                time.sleep(wait)
        return store.delete_dir(folder)


class _Counted:
    """What zipfile needs of a stream that can't seek."""

    def __init__(self, out):
        self.out, self.at = out, 0

    def write(self, data) -> int:
        self.out.write(bytes(data))
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at

    def flush(self) -> None:
        self.out.flush()


def _steps(operations: list[dict]) -> list[tuple]:
    return [(k, o.get("operation"), json.dumps(o.get("parameters", {}), sort_keys=True), o.get("at")) for k, o in enumerate(operations, 1)]


@contextlib.contextmanager
def _sheet(z: zipfile.ZipFile, number: int):
    with z.open(f"xl/worksheets/sheet{number}.xml", "w") as raw:
        put = lambda text: raw.write(text.encode())
        put(f'<?xml version="1.0" encoding="UTF-8"?><worksheet {_SPACE}><sheetData>\n')
        yield put
        put("</sheetData></worksheet>")


def _package(z: zipfile.ZipFile, names: list[str]) -> None:
    """The parts that name the sheets."""
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml."
    sheets = "".join(f'<sheet name={quoteattr(n[:31])} sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(names, 1))
    z.writestr("xl/workbook.xml", f'<workbook {_SPACE} xmlns:r="{_OFFICE}"><sheets>{sheets}</sheets></workbook>')
    relations = lambda rows: '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="{i}" Type="{_OFFICE}/{t}" Target="{x}"/>' for i, t, x in rows) + "</Relationships>"
    z.writestr("xl/_rels/workbook.xml.rels", relations([(f"r{k}", "worksheet", f"worksheets/sheet{k}.xml") for k in range(1, len(names) + 1)]))
    z.writestr("_rels/.rels", relations([("r1", "officeDocument", "xl/workbook.xml")]))
    parts = [("/xl/workbook.xml", "sheet.main+xml"), *((f"/xl/worksheets/sheet{k}.xml", "worksheet+xml") for k in range(1, len(names) + 1))]
    over = "".join(f'<Override PartName="{p}" ContentType="{kinds}{k}"/>' for p, k in parts)
    z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{over}</Types>')


class WorkbookSource(DataSource):
    """Options: path (in a folder that all executors share), sheet, operations and notes (JSON lists of objects)."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def writer(self, schema: StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(schema, dict(self.options), overwrite).prepare()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)
