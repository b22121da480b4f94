"""The cells of a workbook's first sheet as text, read from its zipped XML on the driver.

A workbook is what a person uploads: at most some million rows, and here at
most ``MOST_BYTES`` of XML in a part; larger tables come as delimited text,
which Spark reads. Rows are taken one after the other and nothing of the XML is
kept.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

#: Bytes of the unpacked XML of a sheet or of the shared texts.
MOST_BYTES = 512 << 20
# Fixed values of the format: numbers of the built-in date and time formats, and the day that day 0 is.
DATE_FORMATS = (*range(14, 23), *range(45, 48))
FIRST_DAY = datetime(1899, 12, 30)
FIRST_DAY_1904 = datetime(1904, 1, 1)


def _plain(tag: str) -> str:
    return tag.rpartition("}")[2]


def _part(book: zipfile.ZipFile, name: str) -> io.BufferedIOBase | None:
    try:
        info = book.getinfo(name)
    except KeyError:
        return None
    if info.file_size > MOST_BYTES:
        raise ValueError(f"{name} holds {info.file_size} bytes; a workbook may hold {MOST_BYTES} in a part, larger tables come as delimited text")
    return book.open(info)


def _elements(book: zipfile.ZipFile, name: str, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of a name, each as it is complete; what has been read is given up."""
    file = _part(book, name)
    if file is None:
        return
    with file:
        depth = 0
        for event, e in ElementTree.iterparse(file, ("start", "end")):
            if _plain(e.tag) == tag:
                depth += 1 if event == "start" else -1
                if event == "end" and not depth:
                    yield e
                    e.clear()
            elif event == "end" and not depth:
                e.clear()


def _text(e: ElementTree.Element) -> str:
    """All runs of a text but its phonetic ones."""
    return "".join(t.text or "" for child in e for t in ([child] if _plain(child.tag) == "t" else child if _plain(child.tag) == "r" else []) if _plain(t.tag) == "t")


def _first_sheet(book: zipfile.ZipFile) -> str:
    ids = next(([v for k, v in e.attrib.items() if _plain(k) == "id"] for e in _elements(book, "xl/workbook.xml", "sheet")), [])
    for r in _elements(book, "xl/_rels/workbook.xml.rels", "Relationship"):
        if ids and r.get("Id") == ids[0]:
            target = r.get("Target", "")
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return "xl/worksheets/sheet1.xml"


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Places of the cell formats that show a number as a date or a time."""
    own = {int(e.get("numFmtId", 0)) for e in _elements(book, "xl/styles.xml", "numFmt") if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", e.get("formatCode", "")).lower())}
    formats = next(_elements(book, "xl/styles.xml", "cellXfs"), None)
    kinds = [] if formats is None else [int(x.get("numFmtId", 0)) for x in formats]
    return {k for k, f in enumerate(kinds) if f in DATE_FORMATS or f in own}


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Za-z]*", reference)[0].upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def _shown(raw: str, is_date: bool, first_day: datetime) -> str:
    """A stored number as text: a date by its day, a whole number without a point."""
    if is_date:
        try:
            return str((first_day + timedelta(seconds=round(float(raw) * 86400))))
        except (ValueError, OverflowError):
            return raw
    try:
        x = float(raw)
    except ValueError:
        return raw
    return raw if re.fullmatch(r"-?\d+", raw) else str(int(x)) if x.is_integer() and abs(x) < 1e15 else repr(x)


def rows(source: str | bytes) -> list[list[str]]:
    """All rows of the first sheet up to their last cell; empty cells are empty texts. Raises ValueError for what is no workbook of zipped XML."""
    try:
        book = zipfile.ZipFile(io.BytesIO(source) if isinstance(source, bytes) else source)
    except zipfile.BadZipFile as e:
        raise ValueError("this is no workbook of zipped XML (xlsx, xlsm)") from e
    with book:
        shared = [_text(e) for e in _elements(book, "xl/sharedStrings.xml", "si")]
        dates = _date_styles(book)
        from_1904 = any(e.get("date1904") in ("1", "true") for e in _elements(book, "xl/workbook.xml", "workbookPr"))
        out: list[list[str]] = []
        for row in _elements(book, _first_sheet(book), "row"):
            cells: list[str] = []
            for c in row:
                if _plain(c.tag) != "c":
                    continue
                at = _column(c.get("r", "")) if c.get("r") else len(cells)
                cells += [""] * (at + 1 - len(cells))
                value = next((x.text or "" for x in c if _plain(x.tag) == "v"), "")
                kind = c.get("t", "n")
                if kind == "s":
                    cells[at] = shared[int(value)] if value else ""
                elif kind == "inlineStr":
                    cells[at] = "".join(_text(x) for x in c if _plain(x.tag) == "is")
                elif kind == "b":
                    cells[at] = "True" if value == "1" else "False"
                elif kind in ("str", "e", "d"):
                    cells[at] = value
                elif value:
                    cells[at] = _shown(value, int(c.get("s", 0)) in dates, FIRST_DAY_1904 if from_1904 else FIRST_DAY)
            out.append(cells)
        return out
