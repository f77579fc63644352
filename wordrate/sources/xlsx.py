"""An ``xlsx`` Python data source (read and write).

Reading: a workbook is a zip of XML parts, parsed with the standard library only.  With
``sheet="*"`` (all sheets, plus a ``sheet`` column) the worksheets of every workbook are dealt out
to input partitions by their sizes in its directory, small ones together, a large one by itself;
otherwise (``first`` -- default -- or a sheet's name) a workbook is one partition.  A worksheet is one compressed stream, so it is read by
one task, a row at a time.  Option ``sheets``, a JSON list of names, leaves other sheets out of the
plan.  (Spark's hook for filters, ``pushFilters``, is not used: in Spark 4.1.2 the filters of one
query stay in force for the next one on the same DataFrame, which then misses rows.)  Without a user
schema every column is read as a string named by the header.  A user schema takes its columns by name if the
header (option ``header``, default true) has all of them, so a schema of two columns parses two
cells a row, and by place otherwise.

Writing: every task writes its own workbook (``part-<task>-<id>.xlsx``), with one sheet
(option ``sheet``, default ``Sheet1``) or one sheet per value of option ``sheetColumn``
among the task's rows (a sheet spread over several tasks lands in several part
workbooks; a sheet longer than the format's row limit continues on a numbered sheet).
Characters that XML cannot hold are written as ``_xHHHH_``, as the format has it, and
read back; a name that a sheet cannot have stops the job.
No data passes through the driver.  Tasks
write below a hidden folder of the job; the commit moves the workbooks of the tasks that
succeeded into place (after removing the earlier ones for ``mode("overwrite")``), and an
abort leaves the target as it was.  Rows are read and written one at a time; only cells
that a workbook keeps in its shared string table are held.  Paths are plain file-system
paths, so on a cluster they must be on storage that every executor mounts.
"""

from __future__ import annotations

import glob as _glob
import json
import os
import re
import shutil
import sys
import tempfile
import uuid
import zipfile
from datetime import date, datetime
from decimal import Decimal
from urllib.parse import urlsplit
from urllib.request import url2pathname
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (BooleanType, ByteType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType,
                               StructField, StructType, TimestampNTZType, TimestampType)

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
       "pr": "http://schemas.openxmlformats.org/package/2006/relationships"}


def _local(path: str) -> str:
    """A plain path of a path or a ``file:`` URI."""
    return url2pathname(urlsplit(path).path) if path.startswith("file:") else path


def _files(path: str) -> list[str]:
    path = _local(path)
    if os.path.isdir(path):  # a job's hidden folder is not part of the table
        return sorted(_glob.glob(os.path.join(path, "**", "*.xlsx"), recursive=True))
    return sorted(_glob.glob(path)) or [path]


def _sheets(zf: zipfile.ZipFile) -> list[tuple[str, str]]:
    wb = ET.fromstring(zf.read("xl/workbook.xml"))
    rels = ET.fromstring(zf.read("xl/_rels/workbook.xml.rels"))
    target = {r.get("Id"): r.get("Target") for r in rels.findall("pr:Relationship", _NS)}
    out = []
    for s in wb.findall("m:sheets/m:sheet", _NS):
        rid = s.get("{%s}id" % _NS["r"])
        t = target[rid].lstrip("/")
        out.append((s.get("name"), t if t.startswith("xl/") else "xl/" + t))
    return out


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


_M = "{%s}" % _NS["m"]


_ESCAPED = re.compile(r"_x([0-9A-Fa-f]{4})_")
# what XML cannot hold or would change, and text that looks like an escape
_TO_ESCAPE = re.compile("[\\x00-\\x08\\x0b-\\x1f\ufffe\uffff]|_(?=x[0-9A-Fa-f]{4}_)")


def _text(xml: str) -> str:
    """Cell text from XML text."""
    return _ESCAPED.sub(lambda m: chr(int(m.group(1), 16)), xml) if "_x" in xml else xml


def _xml(text: str) -> str:
    """XML text of a cell."""
    return escape(_TO_ESCAPE.sub(lambda m: f"_x{ord(m.group(0)):04X}_", text))


def _shared_strings(zf: zipfile.ZipFile) -> list[str]:
    out: list[str] = []
    if "xl/sharedStrings.xml" in zf.namelist():
        with zf.open("xl/sharedStrings.xml") as part:
            for _, e in ET.iterparse(part):
                if e.tag == _M + "si":
                    out.append(_text("".join(t.text or "" for t in e.iter(_M + "t"))))
                    e.clear()
    return out


def _value(cell, shared: list[str]):
    kind, v = cell.get("t"), cell.find("m:v", _NS)
    if kind == "inlineStr":
        return _text("".join(x.text or "" for x in cell.iter(_M + "t")))
    if v is None or v.text is None:
        return "" if kind == "str" else None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return v.text == "1"
    if kind in ("str", "e"):
        return _text(v.text)
    if re.fullmatch(r"[+-]?\d+", v.text):
        return int(v.text)  # whole numbers beyond a double's 53 bits stay whole
    return float(v.text)


def _rows(zf: zipfile.ZipFile, part: str, wanted: set[int] | None = None):
    """The rows of a worksheet, parsed one at a time; of cells in other columns than ``wanted``
    (from the second row on) nothing is made."""
    shared = _shared_strings(zf)
    with zf.open(part) as xml:
        data, first = None, True
        for event, e in ET.iterparse(xml, events=("start", "end")):
            if event == "start":
                if e.tag == _M + "sheetData":
                    data = e
                continue
            if e.tag != _M + "row":
                continue
            cells: dict[int, object] = {}
            for i, c in enumerate(e.findall("m:c", _NS)):
                at = _col_index(c.get("r")) if c.get("r") else i
                if first or wanted is None or at in wanted:
                    cells[at] = _value(c, shared)
            wanted = (yield cells) or wanted
            first = False
            if data is not None:
                data.clear()  # rows already read


def _convert(value, dtype):
    if value is None or (value == "" and not isinstance(dtype, StringType)):
        return None
    if isinstance(dtype, StringType):
        return str(value)
    if isinstance(dtype, (LongType, IntegerType, ShortType, ByteType)):
        return int(value) if isinstance(value, int) or re.fullmatch(r"\s*[+-]?\d+\s*", str(value)) else int(float(value))
    if isinstance(dtype, (DoubleType, FloatType)):
        return float(value)
    if isinstance(dtype, DecimalType):
        return round(Decimal(str(value)), dtype.scale)
    if isinstance(dtype, DateType):
        return date.fromisoformat(str(value)[:10])
    if isinstance(dtype, (TimestampType, TimestampNTZType)):
        return datetime.fromisoformat(str(value))
    if isinstance(dtype, BooleanType):
        return value if isinstance(value, bool) else str(value).lower() in ("1", "true")
    return value


class _Part(InputPartition):
    """Sheets of a workbook that one task reads; without names, the one that option ``sheet`` names."""

    def __init__(self, path: str, sheets: list[str] | None = None):
        super().__init__((path, tuple(sheets or ())))
        self.path, self.sheets = path, sheets


_BATCH = 4096  # rows handed to Spark at a time
#: XML of small sheets of a workbook that one task reads (option ``partitionBytes``).
PARTITION_BYTES = 16 << 20


class XlsxReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.options, self.schema = options, schema
        self.choice = options.get("sheet", "first")
        self.with_sheet = self.choice == "*"
        self.only = json.loads(options["sheets"]) if "sheets" in options else None

    def partitions(self):
        files = _files(self.options["path"])
        if not self.with_sheet:
            return [_Part(f) for f in files]
        # of each workbook, only its directory and its list of sheets is read here
        limit, parts = int(self.options.get("partitionBytes", PARTITION_BYTES)), []
        for f in files:
            size = limit
            for name, n in _sheet_sizes(f):
                if self.only is not None and name not in self.only:
                    continue
                if size + n > limit or not parts or parts[-1].path != f:
                    parts.append(_Part(f, []))
                    size = 0
                parts[-1].sheets.append(name)
                size += n
        return parts or [_Part("")]  # a plan has a partition

    def read(self, partition: _Part):
        if not partition.path:
            return
        header = str(self.options.get("header", "true")).lower() == "true"
        fields = [f for f in self.schema.fields if not (self.with_sheet and f.name == "sheet")]
        types = to_arrow_schema(self.schema)
        with zipfile.ZipFile(partition.path) as zf:
            sheets = _sheets(zf)
            names = partition.sheets if self.with_sheet else [sheets[0][0] if self.choice == "first" else self.choice]
            for name, part in sheets:
                if name in names:
                    yield from self._sheet(_rows(zf, part), header, fields, types, name)

    def _sheet(self, rows, header, fields, types, name):
        head = next(rows, None) if header else None
        if header and head is None:
            return
        names = {str(v): i for i, v in sorted((head or {}).items(), reverse=True) if v is not None}
        by_name = bool(fields) and all(f.name in names for f in fields)
        place = [names[f.name] if by_name else i for i, f in enumerate(fields)]
        found = []
        try:
            cells = rows.send(set(place)) if header else next(rows)
            while True:
                found.append([_convert(cells.get(at), f.dataType) for at, f in zip(place, fields)])
                if len(found) == _BATCH:
                    yield self._batch(found, fields, types, name)
                    found = []
                cells = next(rows)
        except StopIteration:
            pass
        if found:
            yield self._batch(found, fields, types, name)

    def _batch(self, rows, fields, types, sheet):
        columns = dict(zip([f.name for f in fields], zip(*rows))) if fields else {}
        if self.with_sheet:
            columns["sheet"] = [sheet] * len(rows)
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in types], schema=types)


def _sheet_sizes(path: str) -> list[tuple[str, int]]:
    """(name, bytes of XML) of a workbook's sheets, from its directory and its list of sheets."""
    with zipfile.ZipFile(path) as zf:
        return [(name, zf.getinfo(part).file_size) for name, part in _sheets(zf)]


def _cell(ref: str, value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{ref}"><v>{repr(value) if isinstance(value, float) else value}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{_xml(str(value))}</t></is></c>'


def _col_name(i: int) -> str:
    s = ""
    i += 1
    while i:
        i, rem = divmod(i - 1, 26)
        s = chr(65 + rem) + s
    return s


MAX_ROWS = 1_048_576  # rows per worksheet, header included (format limit)
MAX_NAME = 31  # characters of a sheet's name (format limit)


def check_sheet_name(name: str) -> str:
    """The name, if the format allows it for a sheet."""
    if not name or len(name) > MAX_NAME or re.search(r"[\[\]:*?/\\\\]", name) or name.startswith("'") or name.endswith("'") or _TO_ESCAPE.search(name):
        raise ValueError(f"{name!r} cannot be the name of a sheet: 1 to {MAX_NAME} characters, none of []:*?/\\ or control characters, no apostrophe at an end")
    return name


class _Book:
    """A workbook written row by row; each open sheet is a file beside it until it is closed."""

    def __init__(self, path: str):
        self.path, self.sheets = path, []  # (name, columns, file, rows)
        self.parts = tempfile.mkdtemp(prefix="sheets-", dir=os.path.dirname(path) or ".")
        self.open: dict[str, int] = {}
        self.total = 0

    def start(self, name: str, columns: list[str], part: int = 1) -> None:
        check_sheet_name(name)
        more = "" if part == 1 else f"_{part}"
        full = name[:MAX_NAME - len(more)] + more
        if full.lower() in {x[0].lower() for x in self.sheets}:
            raise ValueError(f"a workbook cannot hold a second sheet named {full!r} (case does not tell sheets apart)")
        f = open(os.path.join(self.parts, f"{len(self.sheets)}.xml"), "w", encoding="utf-8")
        f.write('<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
        self.sheets.append([full, columns, f, 1, part])
        self.open[name] = len(self.sheets) - 1
        self._row(self.sheets[-1], columns)

    @staticmethod
    def _row(sheet, values) -> None:
        k = sheet[3]
        sheet[2].write(f'<row r="{k}">' + "".join(_cell(f"{_col_name(i)}{k}", v) for i, v in enumerate(values)) + "</row>")
        sheet[3] = k + 1

    def add(self, name: str, columns: list[str], values) -> None:
        if name not in self.open:
            self.start(name, columns)
        sheet = self.sheets[self.open[name]]
        if sheet[3] > MAX_ROWS:  # the format's limit: go on in a numbered sheet
            self.start(name, columns, sheet[4] + 1)
            sheet = self.sheets[self.open[name]]
        self._row(sheet, values)
        self.total += 1

    def close(self) -> int:
        n = len(self.sheets)
        with zipfile.ZipFile(self.path, "w", zipfile.ZIP_DEFLATED) as zf:
            overrides = "".join(
                f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" '
                'ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
                for i in range(n))
            zf.writestr("[Content_Types].xml",
                        '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
                        '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
                        '<Default Extension="xml" ContentType="application/xml"/>'
                        '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
                        + overrides + '</Types>')
            zf.writestr("_rels/.rels",
                        '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                        '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/>'
                        '</Relationships>')
            zf.writestr("xl/workbook.xml",
                        '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
                        'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>'
                        + "".join(f'<sheet name={quoteattr(x[0])} sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, x in enumerate(self.sheets))
                        + '</sheets></workbook>')
            zf.writestr("xl/_rels/workbook.xml.rels",
                        '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                        + "".join(f'<Relationship Id="rId{i + 1}" Type="http://schemas.openxmlformats.org/officeDocument/2006/'
                                  f'relationships/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(n))
                        + '</Relationships>')
            for i, sheet in enumerate(self.sheets):
                sheet[2].write("</sheetData></worksheet>")
                sheet[2].close()
                zf.write(sheet[2].name, f"xl/worksheets/sheet{i + 1}.xml")
        shutil.rmtree(self.parts)
        return self.total

    def discard(self) -> None:
        for sheet in self.sheets:
            sheet[2].close()
        shutil.rmtree(self.parts, ignore_errors=True)


def write_workbook_sheets(path: str, sheets) -> int:
    """Write a workbook with one worksheet per (name, columns, rows) entry; rows may be any
    iterable.  A sheet longer than the format allows continues on ``<name>_2``,
    ``<name>_3``... so no row is dropped."""
    book = _Book(path)
    for name, cols, rows in sheets:
        book.start(name, cols)
        for r in rows:
            book.add(name, cols, r)
    return book.close()


def write_workbook(path: str, sheet: str, columns: list[str], rows) -> int:
    return write_workbook_sheets(path, [(sheet, columns, rows)])


class _Done(WriterCommitMessage):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows


class XlsxWriter(DataSourceWriter):
    def __init__(self, options, schema: StructType, overwrite: bool = False):
        self.options, self.schema, self.overwrite = options, schema, overwrite
        self.job = uuid.uuid4().hex

    @property
    def _staging(self) -> str:
        return os.path.join(_local(self.options["path"]), f".job-{self.job}")

    def write(self, iterator):
        """One workbook per task.  With option ``sheetColumn`` the rows go to one worksheet
        per value of that column (the column itself is not written); otherwise all go to
        the sheet named by option ``sheet``.  An attempt has a folder of its own, so a
        retried or speculative task never adds to another's rows."""
        from pyspark import TaskContext
        ctx = TaskContext.get()
        folder = os.path.join(self._staging, uuid.uuid4().hex)
        os.makedirs(folder)
        path = os.path.join(folder, f"part-{ctx.partitionId():05d}-{self.job}.xlsx")
        names = [f.name for f in self.schema.fields]
        by = self.options.get("sheetColumn")
        idx = names.index(by) if by else None
        cols = [c for c in names if c != by]
        book = _Book(path)
        try:
            if idx is None:
                sheet = self.options.get("sheet", "Sheet1")
                book.start(sheet, cols)
                for r in iterator:
                    book.add(sheet, cols, tuple(r))
            else:
                for r in iterator:
                    vals = tuple(r)
                    book.add(str(vals[idx]), cols, vals[:idx] + vals[idx + 1:])
                if not book.sheets:
                    book.start(self.options.get("sheet", "Sheet1"), cols)
            n = book.close()
        except BaseException:
            book.discard()
            raise
        return _Done(path, n)

    def commit(self, messages) -> None:
        """Runs once, on the driver: what the successful attempts wrote takes its place."""
        folder = _local(self.options["path"])
        before = [f for f in _files(folder) if os.path.isfile(f)] if os.path.isdir(folder) else []
        os.makedirs(folder, exist_ok=True)
        for m in messages:
            if m is not None:
                os.replace(m.path, os.path.join(folder, os.path.basename(m.path)))
        if self.overwrite:
            for f in before:
                os.remove(f)
        shutil.rmtree(self._staging, ignore_errors=True)

    def abort(self, messages) -> None:
        shutil.rmtree(self._staging, ignore_errors=True)


class XlsxDataSource(DataSource):
    @classmethod
    def name(cls):
        return "xlsx"

    def schema(self):
        path = _files(self.options["path"])[0]
        with zipfile.ZipFile(path) as zf:
            name, part = _sheets(zf)[0]
            cells = next(_rows(zf, part), {})
        head = [cells.get(i) for i in range(max(cells) + 1)] if cells else []
        names = [str(h) if h is not None else f"_c{i}" for i, h in enumerate(head)]
        if str(self.options.get("header", "true")).lower() != "true":
            names = [f"_c{i}" for i in range(len(head))]
        fields = [StructField(n, StringType()) for n in names]
        if self.options.get("sheet", "first") == "*":
            fields.append(StructField("sheet", StringType()))
        return StructType(fields)

    def reader(self, schema: StructType):
        return XlsxReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool):
        return XlsxWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    # by value: Python workers need no copy of the package
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(XlsxDataSource)


def sheet_names(path: str) -> list[str]:
    """Sheet names of one workbook in workbook order (the first one is the sheet
    the merge rewrites).  Reads only the workbook's sheet list."""
    return [name for name, _ in _sheet_sizes(_files(path)[0])]
