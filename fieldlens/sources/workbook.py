"""Workbooks as tables: cells, sheets, anchors of images, and media, from .xlsx files.

A workbook is one row of Spark's binaryFile source and is taken apart where it is read; shared strings
never leave the task. Files are read through Spark, so they may lie in any store.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.shipping import ship

CELLS = "workbook string, sheet_no int, sheet string, ord long, row int, col int, value string, is_str boolean"
SHEETS = "workbook string, sheet_no int, sheet string, path string, drawing string"
ANCHORS = "workbook string, sheet_no int, sheet string, anchor_no int, row int, col int, media string"
MEDIA = "workbook string, media string, mime string, content binary"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _local(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _find(root: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (e for e in root.iter() if _local(e) == name)


def resolve(base: str, target: str) -> str:
    """The path inside the zip that a target of the part base means."""
    return target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(posixpath.dirname(base), target))


def _xml(z: zipfile.ZipFile, path: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(z.read(path)) if path in z.namelist() else None


def _relations(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    root = _xml(z, posixpath.join(posixpath.dirname(part), "_rels", posixpath.basename(part) + ".rels"))
    return {} if root is None else {e.get("Id", ""): resolve(part, e.get("Target", "")) for e in _find(root, "Relationship")}


def sheets_of(z: zipfile.ZipFile) -> list[tuple[int, str, str, str | None]]:
    """(number, name, path, drawing path) in the workbook's order; sheets without a part go."""
    book = "xl/workbook.xml"
    root = _xml(z, book)
    if root is None:
        return []
    rels, out = _relations(z, book), []
    for k, e in enumerate(_find(root, "sheet")):
        path = rels.get(e.get(f"{REL}id", ""))
        if path in z.namelist():
            sheet = _xml(z, path)
            own = _relations(z, path)
            drawing = next((own.get(d.get(f"{REL}id", "")) for d in _find(sheet, "drawing")), None)
            out.append((k, e.get("name", ""), path, drawing))
    return out


def shared_strings(z: zipfile.ZipFile) -> list[str]:
    root = _xml(z, "xl/sharedStrings.xml")
    return [] if root is None else ["".join(t.text or "" for t in _find(si, "t")).strip() for si in _find(root, "si")]


def place(ref: str) -> tuple[int, int] | None:
    """0-based (row, column) of a reference such as AB12."""
    m = re.fullmatch(r"([A-Za-z]+)(\d+)", ref or "")
    if not m:
        return None
    col = 0
    for c in m[1].upper():
        col = col * 26 + ord(c) - 64
    return int(m[2]) - 1, col - 1


def cells_of(z: zipfile.ZipFile, path: str, strings: list[str]) -> list[tuple[int, int, str, bool]]:
    """(row, column, value, is text) by document order; of repeated references the last stays, at the first one's place."""
    root = _xml(z, path)
    found: dict[tuple[int, int], tuple[str, bool]] = {}
    for c in _find(root, "c") if root is not None else ():
        at = place(c.get("r", ""))
        if at is None:
            continue
        kind = c.get("t")
        v = next((x.text for x in c if _local(x) == "v"), None)
        if kind == "inlineStr":
            value, text = "".join(t.text or "" for t in _find(c, "t")).strip(), True
        elif v is None:
            continue
        elif kind == "s":
            i = int(v) if v.strip().isdigit() else -1
            value, text = (strings[i] if 0 <= i < len(strings) else v.strip()), True
        else:
            value, text = v.strip(), kind == "str"
        if value:
            found[at] = (value, text)
    return [(r, c, *v) for (r, c), v in found.items()]


def anchors_of(z: zipfile.ZipFile, drawing: str | None) -> list[tuple[int, int, str]]:
    """(row, column, media path) of a drawing's images; anchors without an image go."""
    root = _xml(z, drawing) if drawing else None
    if root is None:
        return []
    rels, out = _relations(z, drawing), []
    for a in root:
        if _local(a) not in ("twoCellAnchor", "oneCellAnchor"):
            continue
        start = next((x for x in a if _local(x) == "from"), None)
        media = next((rels.get(b.get(f"{REL}embed", "")) for b in _find(a, "blip")), None)
        if start is None or media is None:
            continue
        at = {_local(x): int(x.text or 0) for x in start if _local(x) in ("row", "col")}
        out.append((at.get("row", 0), at.get("col", 0), media))
    return out


def _mime(content: bytes) -> str:
    return "image/png" if content[:8] == b"\x89PNG\r\n\x1a\n" else "image/jpeg" if content[:2] == b"\xff\xd8" else "application/octet-stream"


def _table(schema: str, rows: Callable[[str, zipfile.ZipFile], Iterator[tuple]]):
    names = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for path, content in zip(pdf.path, pdf.content, strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        got = list(rows(path, z))
                except zipfile.BadZipFile:
                    continue  # no workbook: no rows
                if got:
                    out = pd.DataFrame(got, columns=names)
                    for c in schema.split(", "):
                        name, kind = c.split()
                        if kind in ("int", "long"):
                            out[name] = out[name].astype("int32" if kind == "int" else "int64")
                    yield out

    return run


def files(spark: SparkSession, path: str) -> DataFrame:
    ship(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_cells(books: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    """Cells of each workbook (path, content), of the sheets named in only if given: others are not parsed."""

    def rows(path: str, z: zipfile.ZipFile) -> Iterator[tuple]:
        strings = shared_strings(z)
        for no, name, part, _ in sheets_of(z):
            if only is None or name in only:
                for k, (r, c, v, t) in enumerate(cells_of(z, part, strings)):
                    yield path, no, name, k, r, c, v, t

    return books.mapInPandas(_table(CELLS, rows), CELLS)


def read_sheets(books: DataFrame) -> DataFrame:
    return books.mapInPandas(_table(SHEETS, lambda path, z: ((path, *s) for s in sheets_of(z))), SHEETS)


def read_anchors(books: DataFrame) -> DataFrame:
    def rows(path: str, z: zipfile.ZipFile) -> Iterator[tuple]:
        for no, name, _, drawing in sheets_of(z):
            for k, (r, c, media) in enumerate(anchors_of(z, drawing)):
                yield path, no, name, k, r, c, media

    return books.mapInPandas(_table(ANCHORS, rows), ANCHORS)


def read_media(books: DataFrame) -> DataFrame:
    def rows(path: str, z: zipfile.ZipFile) -> Iterator[tuple]:
        for name in z.namelist():
            if name.startswith("xl/media/"):
                content = z.read(name)
                yield path, name, _mime(content), content

    return books.mapInPandas(_table(MEDIA, rows), MEDIA)


def image_mime(content: Column) -> Column:
    """MIME type by the first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head == "89504E470D0A1A0A", "image/png").when(head.startswith("FFD8"), "image/jpeg").otherwise("application/octet-stream")


def write_workbook(sheets: dict[str, list[tuple[int, int, str | float]]], images: dict[str, list[tuple[int, int, bytes]]] | None = None) -> bytes:
    """A small workbook: cells (row, col, value) and PNG images (row, col, content) by sheet. For fixtures and exports."""
    from xml.sax.saxutils import escape, quoteattr

    def ref(r: int, c: int) -> str:
        letters = ""
        c += 1
        while c:
            c, k = divmod(c - 1, 26)
            letters = chr(65 + k) + letters
        return f"{letters}{r + 1}"

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pkg = "http://schemas.openxmlformats.org/package/2006/relationships"
    strings: list[str] = []
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        n_media = 0
        for k, (_, cells) in enumerate(sheets.items(), 1):
            by_row: dict[int, list[str]] = {}
            for r, c, v in sorted(cells, key=lambda x: x[:2]):
                if isinstance(v, str):
                    strings.append(v)
                    cell = f'<c r="{ref(r, c)}" t="s"><v>{len(strings) - 1}</v></c>'
                else:
                    cell = f'<c r="{ref(r, c)}"><v>{v}</v></c>'
                by_row.setdefault(r, []).append(cell)
            pictures = (images or {}).get(list(sheets)[k - 1], [])
            body = "".join(f'<row r="{r + 1}">{"".join(cs)}</row>' for r, cs in sorted(by_row.items()))
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{main}" xmlns:r="{rel}"><sheetData>{body}</sheetData>{f"""<drawing r:id="rId1"/>""" if pictures else ""}</worksheet>')
            if pictures:
                z.writestr(f"xl/worksheets/_rels/sheet{k}.xml.rels", f'<Relationships xmlns="{pkg}"><Relationship Id="rId1" Target="../drawings/drawing{k}.xml"/></Relationships>')
                anchors, links = "", ""
                for i, (r, c, content) in enumerate(pictures, 1):
                    n_media += 1
                    z.writestr(f"xl/media/image{n_media}.png", content)
                    links += f'<Relationship Id="rId{i}" Target="../media/image{n_media}.png"/>'
                    anchors += f'<xdr:twoCellAnchor><xdr:from><xdr:col>{c}</xdr:col><xdr:row>{r}</xdr:row></xdr:from><xdr:pic><a:blip r:embed="rId{i}"/></xdr:pic></xdr:twoCellAnchor>'
                z.writestr(f"xl/drawings/drawing{k}.xml", f'<xdr:wsDr xmlns:xdr="urn:x" xmlns:a="urn:a" xmlns:r="{rel}">{anchors}</xdr:wsDr>')
                z.writestr(f"xl/drawings/_rels/drawing{k}.xml.rels", f'<Relationships xmlns="{pkg}">{links}</Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{pkg}">' + "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si><t>{escape(s)}</t></si>" for s in strings) + "</sst>")
    return out.getvalue()
