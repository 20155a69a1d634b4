"""Workbooks: a sink that commits in two steps, a reader, and a stream of changed files.

Sink: ``df.write.format("xlsx").mode("append").save(folder)`` after :func:`register`; rows are (doc_id, sheet, row, col,
value, number, fmt, style[, profile]), as :func:`gridloom.operators.sheets.sheet_plan` makes them.  Rows of one document must be in one partition, sorted by sheet, row and
column: :func:`arranged` does that.  A task writes its workbooks under names of its own in ``<folder>/_temporary/<job>``; once all tasks have
succeeded the driver moves the files of the attempts that count to their final names, so a task that fails or runs twice leaves nothing behind and a reader
never sees half a file.  ``overwrite`` mode deletes other workbooks of the folder then, not before.  A file is named by its document, with
what a file name cannot hold written in hexadecimal, so different documents never share a file.

Reader: ``spark.read.format("xlsx").load(folder)`` gives (path, modified, sheet, row, col, value, number, head): the filled cells of all sheets, one
partition for each group of files.  ``number`` is null for texts, ``value`` is a number's shortest text, ``head`` the last frozen row (-1: none), ``modified`` the file's time in nanoseconds.
``readStream`` gives files that are new or changed since the last batch; an offset is a point in time, so it stays small however many files there are.

Folders are reached through Arrow's file systems: local and mounted paths, ``file:``, ``hdfs:`` and ``s3:``.
"""

from __future__ import annotations

import re
import time
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from math import isfinite
from uuid import uuid4
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.cells import HEADER_FORMATS, NUMBER_FORMATS

HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"

# -- styles ------------------------------------------------------------------------------------------

FORMATS = ["General", "#,##0", "#,##0.00", "0.0%", "0.000", NUMBER_FORMATS["demand_forecast"], HEADER_FORMATS["demand_forecast"]]
#: By profile the fills and font colour and sizes of headers and subtotals; unknown profiles are like the default.
PROFILES = {
    "default": {"header": "FFD9E2F3", "subtotal": "FFF2F2F2", "header_font": "FF000000", "header_size": 11, "size": 10},
    "financial_statement": {"header": "FFD9E2F3", "subtotal": "FFF2F2F2", "header_font": "FF000000", "header_size": 11, "size": 10},
    "demand_forecast": {"header": "FF002060", "subtotal": "FFE2EFDA", "header_font": "FFFFFFFF", "header_size": 10, "size": 10},
}
ERROR_FILL, FONT = "FFFFFF00", "맑은 고딕"
FILLS = ["none", "header", "subtotal", "error"]
FONTS = ["data", "header", "bold", "italic", "title", "meta"]
BORDERS = ["none", "thin", "header", "total"]
#: Font, fill, border and alignment (of the first column, of others) of each role.
ROLES = {
    "head": ("header", "header", "header", "middle", "middle"), "header": ("header", "header", "header", "center", "center"), "subtotal": ("bold", "subtotal", "total", "center", "right"),
    "summary": ("bold", "none", "total", "center", "right"), "category": ("bold", "none", "thin", "left", "right"), "detail": ("data", "none", "thin", "indent", "right"),
    "period": ("italic", "none", "thin", "center", "center"), "normal": ("data", "none", "thin", "left", "center"), "title": ("title", "none", "none", "upright", "upright"),
    "meta": ("meta", "none", "none", "none", "none"), "meta-number": ("meta", "none", "none", "right", "right"),
}
ALIGNMENTS = {
    "none": "", "left": '<alignment horizontal="left" vertical="center"/>', "right": '<alignment horizontal="right" vertical="center"/>', "center": '<alignment horizontal="center" vertical="center"/>',
    "middle": '<alignment horizontal="center" vertical="center" wrapText="1"/>', "indent": '<alignment vertical="center" indent="2"/>', "upright": '<alignment vertical="center"/>',
}


def style_names() -> list[str]:
    """Every style of a plan: a role, ``-first`` for the first column, ``!`` for a marked cell; ``error`` is a marked normal cell."""
    return [f"{role}{first}{error}" for role in ROLES for first in ("", "-first") for error in ("", "!")]


STYLE_PLACES = {name: i for i, name in enumerate(style_names())}


def style_index(style: str | None, fmt: str | None) -> int:
    style = {"error": "normal!"}.get(style, style) or "normal"
    return STYLE_PLACES[style] * len(FORMATS) + FORMATS.index(fmt or "General")


def styles_xml(profile: str = "default") -> str:
    p = PROFILES.get(profile, PROFILES["default"])
    formats = "".join(f'<numFmt numFmtId="{164 + k}" formatCode={quoteattr(f)}/>' for k, f in enumerate(FORMATS) if k)
    font = lambda size, mark="", color="FF000000": f'<font>{mark}<sz val="{size}"/><color rgb="{color}"/><name val="{FONT}"/></font>'
    fonts = [font(p["size"]), font(p["header_size"], "<b/>", p["header_font"]), font(p["size"], "<b/>"), font(p["size"], "<i/>"), font(14, "<b/>"), font(10)]
    solid = lambda rgb: f'<fill><patternFill patternType="solid"><fgColor rgb="{rgb}"/></patternFill></fill>'
    fills = ['<fill><patternFill patternType="none"/></fill>', '<fill><patternFill patternType="gray125"/></fill>', solid(p["header"]), solid(p["subtotal"]), solid(ERROR_FILL)]
    side = lambda name, kind, rgb: f'<{name} style="{kind}"><color rgb="{rgb}"/></{name}>'
    border = lambda wide, tall, a, b: f"<border>{side('left', 'thin', a)}{side('right', 'thin', a)}{side('top', tall, b)}{side('bottom', tall, b)}</border>"
    borders = ["<border/>", border("thin", "thin", "FFCCCCCC", "FFCCCCCC"), border("thin", "medium", "FF999999", "FF666666"), border("thin", "thin", "FFCCCCCC", "FF999999")]
    cells = []
    for name in style_names():
        role = name.removesuffix("!").removesuffix("-first")
        face, fill, edge, first, other = ROLES[role]
        fill_id = 4 if name.endswith("!") else {"none": 0, "header": 2, "subtotal": 3}[fill]
        align = ALIGNMENTS[first if "-first" in name else other]
        for k in range(len(FORMATS)):
            applied = f'numFmtId="{164 + k if k else 0}" fontId="{FONTS.index(face)}" fillId="{fill_id}" borderId="{BORDERS.index(edge)}" xfId="0" applyNumberFormat="1" applyFont="1" applyFill="1" applyBorder="1" applyAlignment="1"'
            cells.append(f"<xf {applied}>{align}</xf>")
    listed = lambda tag, items: f'<{tag} count="{len(items)}">{"".join(items)}</{tag}>'
    return f'{HEAD}<styleSheet xmlns="{MAIN}"><numFmts count="{len(FORMATS) - 1}">{formats}</numFmts>{listed("fonts", fonts)}{listed("fills", fills)}{listed("borders", borders)}<cellStyleXfs count="1"><xf/></cellStyleXfs>{listed("cellXfs", cells)}</styleSheet>'


# -- files -------------------------------------------------------------------------------------------


def column_name(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def display_width(text: str) -> int:
    return sum(2 if ord(ch) > 0x7F else 1 for ch in text)


def column_widths(rows: list, demand: bool) -> dict[int, int]:
    """Width of each column by its widest text; fixed values by profile."""
    widest: dict[int, int] = {}
    for r in rows:
        text = r["value"] if r["number"] is None else f"{r['number']:g}"
        widest[r["col"]] = max(widest.get(r["col"], 0), display_width(text or ""))
    if demand:
        return {k: max(w + (3 if k < 6 else 2), 14 if k < 6 else 7) for k, w in widest.items()}
    return {k: max(w + (3 if k else 4), 18 if k else 30) for k, w in widest.items()}


def sheet_xml(rows: list, profile: str = "default") -> str:
    """A sheet of sorted rows, frozen below its column names (below the first row, if it has none)."""
    body, last = [], None
    widths = "".join(f'<col min="{k + 1}" max="{k + 1}" width="{w}" customWidth="1"/>' for k, w in sorted(column_widths(rows, profile == "demand_forecast").items()))
    cols = f"<cols>{widths}</cols>" if widths else ""
    freeze = max((r["row"] for r in rows if (r["style"] or "").startswith("head") and not r["style"].startswith("header")), default=0) + 1
    for r in rows:
        if r["row"] != last:
            body.append(("</row>" if last is not None else "") + f'<row r="{r["row"] + 1}">')
            last = r["row"]
        style = style_index(r["style"], r["fmt"])
        ref = f'{column_name(r["col"])}{r["row"] + 1}'
        if r["number"] is not None and isfinite(r["number"]):
            body.append(f'<c r="{ref}" s="{style}"><v>{r["number"]!r}</v></c>')
        else:
            body.append(f'<c r="{ref}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{plain(r["value"] or "")}</t></is></c>')
    if last is not None:
        body.append("</row>")
    view = f'<sheetViews><sheetView workbookViewId="0"><pane ySplit="{freeze}" topLeftCell="A{freeze + 1}" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
    return f'{HEAD}<worksheet xmlns="{MAIN}">{view}<sheetFormatPr defaultRowHeight="20"/>{cols}<sheetData>{"".join(body)}</sheetData></worksheet>'


def plain(text: str) -> str:
    """Text for XML: what XML cannot hold is left out."""
    return escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]", "", text))


def workbook(out, sheets: dict[str, list], profile: str = "default") -> None:
    """Write one file to a stream; a document without cells gets one empty sheet."""
    sheets = sheets or {"결과": []}
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        names = list(sheets)
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(len(names)))
        z.writestr("[Content_Types].xml", f'{HEAD}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{HEAD}<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(names)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i + 1}" Type="{REL}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(names))) + f'<Relationship Id="rId{len(names) + 1}" Type="{REL}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", styles_xml(profile))
        for i, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", sheet_xml(rows, profile))


def file_name(doc: str) -> str:
    """A file name of its own for each document; the sign for hexadecimal is itself written so."""
    return re.sub(r"[^\w.-]|%", lambda m: "".join(f"%{b:02x}" for b in m[0].encode()), doc) + ".xlsx"


def place_of(text: str) -> int:
    """Column of a cell's name, from 0."""
    n = 0
    for ch in re.match("[A-Z]+", text)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def sheets_of(source) -> Iterator[tuple[str, int, int, int, str, float | None]]:
    """(sheet, head, row, col, value, number) of the filled cells of a workbook."""
    ns = {"m": MAIN, "p": f"{PACKAGE}/relationships"}
    with zipfile.ZipFile(source) as z:
        known = set(z.namelist())
        parse = lambda name: ElementTree.fromstring(z.read(name))
        shared = ["".join(t.text or "" for t in si.iter(f"{{{MAIN}}}t")) for si in parse("xl/sharedStrings.xml").findall("m:si", ns)] if "xl/sharedStrings.xml" in known else []
        targets = {r.get("Id"): r.get("Target") for r in parse("xl/_rels/workbook.xml.rels")}
        for sheet in parse("xl/workbook.xml").find("m:sheets", ns):
            target = targets[sheet.get(f"{{{REL}}}id")]
            tree = parse(target.lstrip("/") if target.startswith("/") else f"xl/{target}")
            pane = tree.find("m:sheetViews/m:sheetView/m:pane", ns)
            head = int(float(pane.get("ySplit", "0"))) - 1 if pane is not None else -1
            row = -1
            for line in tree.iter(f"{{{MAIN}}}row"):
                row = int(line.get("r")) - 1 if line.get("r") else row + 1
                col = -1
                for cell in line.findall("m:c", ns):
                    col = place_of(cell.get("r")) if cell.get("r") else col + 1
                    kind, value = cell.get("t", "n"), cell.findtext("m:v", None, ns)
                    if kind == "inlineStr":
                        value = "".join(t.text or "" for t in cell.iter(f"{{{MAIN}}}t"))
                    elif kind == "s":
                        value = shared[int(value)]
                    number = float(value) if kind == "n" and value is not None else None
                    if number is not None:
                        value = str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)
                    if value:
                        yield sheet.get("name"), head, row, col, value, number


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def workbooks(path: str) -> list[tuple[str, int]]:
    """Path and time of the workbooks of a folder, or of one file; hidden and unfinished ones do not count."""
    where, inside = opened(path)
    info = where.get_file_info(inside)
    if info.type == fs.FileType.File:
        found = [info]
    elif info.type == fs.FileType.NotFound:
        found = []
    else:
        found = [f for f in where.get_file_info(fs.FileSelector(inside)) if f.type == fs.FileType.File and f.base_name.endswith(".xlsx") and f.base_name[0] not in "._~"]
    return sorted((f.path, f.mtime_ns) for f in found)


# -- sink --------------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # where the attempt has left a file, and its final name


class Writer(DataSourceWriter):
    def __init__(self, path: str, profile: str, overwrite: bool) -> None:
        self.path, self.profile, self.overwrite = path, profile, overwrite
        self.job = f"{opened(path)[1]}/_temporary/{uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        where, _ = opened(self.path)
        own = f"{self.job}/{uuid4().hex}"  # each attempt of a task has a folder of its own
        done: list[tuple[str, str]] = []
        current, profile, sheets = None, None, {}

        def close() -> None:
            if current is not None:
                name = file_name(str(current))
                where.create_dir(own, recursive=True)
                with where.open_output_stream(f"{own}/{name}") as out:
                    workbook(out, sheets, profile or self.profile)
                done.append((f"{own}/{name}", name))

        for r in rows:
            if r["doc_id"] != current:
                close()
                current, profile, sheets = r["doc_id"], r["profile"] if "profile" in r.__fields__ else None, {}
            sheets.setdefault(r["sheet"], []).append(r)
        close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        where, folder = opened(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("rows of one document are in several partitions; see arranged()")
        where.create_dir(folder, recursive=True)
        for at, name in files:
            where.move(at, f"{folder}/{name}")
        if self.overwrite:
            for old, _ in workbooks(self.path):
                if old.rsplit("/", 1)[-1] not in set(names):
                    where.delete_file(old)
        self.clear(where)

    def abort(self, messages: list[Written | None]) -> None:
        self.clear(opened(self.path)[0])

    def clear(self, where: fs.FileSystem) -> None:
        """Delete what this job's attempts have left, and the folder of all jobs if that was the last."""
        parent = self.job.rsplit("/", 1)[0]
        for folder in (self.job, parent):
            if where.get_file_info(folder).type == fs.FileType.Directory and (folder == self.job or not where.get_file_info(fs.FileSelector(parent))):
                where.delete_dir(folder)


# -- reader ------------------------------------------------------------------------------------------

CELLS = "path string, modified long, sheet string, row int, col int, value string, number double, head int"


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]


def grouped(files: list[tuple[str, int]], size: int) -> list[Files]:
    return [Files(files[a : a + size]) for a in range(0, len(files), size)]


def cells_of(path: str, part: Files) -> Iterator[tuple]:
    where, _ = opened(path)
    for name, modified in part.files:
        with where.open_input_file(name) as source:
            for sheet, head, row, col, value, number in sheets_of(source):
                yield name, modified, sheet, row, col, value, number, head


class Reader(DataSourceReader):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size

    def partitions(self) -> list[Files]:
        return grouped(workbooks(self.path), self.size) or [Files([])]

    def read(self, part: Files) -> Iterator[tuple]:
        return cells_of(self.path, part)


class StreamReader(DataSourceStreamReader):
    """Offsets are times: a batch has the files whose time lies between two of them.

    A file counts once its time is ``settle`` seconds past, so that one written in the same instant as another is not missed.
    """

    def __init__(self, path: str, size: int, settle: float) -> None:
        self.path, self.size, self.settle = path, size, settle

    def initialOffset(self) -> dict:
        return {"time": 0}

    def latestOffset(self) -> dict:
        return {"time": max((t for _, t in workbooks(self.path) if t <= time.time_ns() - self.settle * 1e9), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return grouped([f for f in workbooks(self.path) if start["time"] < f[1] <= end["time"]], self.size) or [Files([])]

    def read(self, part: Files) -> Iterator[tuple]:
        return cells_of(self.path, part)


class Xlsx(DataSource):
    """Options: ``path``, a folder that all executors can reach; ``profile`` of the sink; ``filesPerTask`` (16) and ``settle`` (2 seconds) of the readers."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return CELLS

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], self.options.get("profile", "default"), overwrite)

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("filesPerTask", 16)))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options["path"], int(self.options.get("filesPerTask", 16)), float(self.options.get("settle", 2)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Xlsx)


def arranged(plan: DataFrame) -> DataFrame:
    """Rows of a document together and in order."""
    cols = [F.col(x) for x in ("doc_id", "sheet", "row", "col", "value", "number", "fmt", "style", *["profile"] * ("profile" in plan.columns))]
    return plan.select(*cols).repartition("doc_id").sortWithinPartitions("doc_id", "sheet", "row", "col")
