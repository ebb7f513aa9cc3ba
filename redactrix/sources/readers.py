"""Readers of file formats, with the standard library only; PDF and pictures need optional packages."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE = "doc_id long, page_no int, text string, error string"


def decode(data: bytes) -> str:
    """Bytes of an unknown encoding: marks first, then UTF-8, then the Cyrillic code page that gives the most usual letters."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "ignore")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        pass
    usual = "оеаинтсрвлкмдпу"
    return max((data.decode(c, "ignore") for c in ("cp1251", "koi8-r", "cp866")), key=lambda s: sum(s.count(x) for x in usual))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attribute(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if _local(k) == name), None)


def read_docx(data: bytes) -> list[str]:
    """Headers, body and footers; a paragraph a line, tabs and breaks as they are."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        parts = [n for n in sorted(names) if re.fullmatch(r"word/header\d*\.xml", n)] + ["word/document.xml"] + [n for n in sorted(names) if re.fullmatch(r"word/footer\d*\.xml", n)]
        for part in parts:
            for p in ET.fromstring(z.read(part)).iter():
                if _local(p.tag) == "p":
                    say = {"t": lambda e: e.text or "", "tab": lambda e: "\t", "br": lambda e: "\n", "cr": lambda e: "\n"}
                    out.append("".join(say[_local(e.tag)](e) for e in p.iter() if _local(e.tag) in say))
    return ["\n".join(out)]


def _spoken(e: ET.Element) -> str:
    """Text of an OpenDocument element with its written-out spaces, tabs and breaks."""
    out = [e.text or ""]
    for c in e:
        out.append({"s": " " * int(_attribute(c, "c") or 1), "tab": "\t", "line-break": "\n"}.get(_local(c.tag)) or _spoken(c))
        out.append(c.tail or "")
    return "".join(out)


def _content(data: bytes) -> ET.Element:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return ET.fromstring(z.read("content.xml"))


def read_odt(data: bytes) -> list[str]:
    return ["\n".join(_spoken(e) for e in _content(data).iter() if _local(e.tag) == "p")]


def length_mm(value: str | None) -> float:
    m = re.match(r"\s*(-?\d+(?:\.\d+)?)\s*([a-z]*)", value or "", re.I)
    return float(m[1]) * {"cm": 10.0, "in": 25.4, "pt": 25.4 / 72, "pc": 25.4 / 6, "px": 25.4 / 96}.get(m[2].lower(), 1.0) if m else 0.0


def read_odg(data: bytes) -> list[str]:
    """A drawing's pages; shapes from top to bottom and left to right."""
    root = _content(data)
    said = lambda e: "\n".join(filter(None, (_spoken(p) for p in e.iter() if _local(p.tag) == "p")))
    pages = []
    for page in (e for e in root.iter() if _local(e.tag) == "page"):
        shapes = [e for e in page.iter() if e is not page and _attribute(e, "x") is not None and _attribute(e, "y") is not None] or list(page)
        placed = sorted(((length_mm(_attribute(e, "y")), length_mm(_attribute(e, "x")), i, said(e)) for i, e in enumerate(shapes)), key=lambda s: s[:3])
        pages.append("\n".join(s[3] for s in placed if s[3]))
    return ["\n\n".join(pages)] if pages else [said(root)]


def _rtf_text(s: str) -> str:
    out: list[str] = []
    stack: list[tuple[bool, int]] = []
    hidden, skip_after, skip, code_page = False, 1, 0, "cp1251"
    token = re.compile(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-f]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)", re.I)
    silent = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "object", "header", "footer", "themedata", "datastore"}
    for m in token.finditer(s):
        word, number, hexed, symbol, brace, plain = m.groups()
        if brace == "{":
            stack.append((hidden, skip_after))
        elif brace == "}":
            hidden, skip_after = stack.pop() if stack else (False, 1)
        elif symbol == "*":
            hidden = True
        elif word:
            if word in silent:
                hidden = True
            elif word == "ansicpg" and number:
                code_page = f"cp{number}"
            elif word == "uc" and number:
                skip_after = int(number)
            elif not hidden and word in ("par", "line", "row", "sect", "page"):
                out.append("\n")
            elif not hidden and word in ("tab", "cell"):
                out.append("\t")
            elif not hidden and word == "u" and number:
                out.append(chr(int(number) % 65536))
                skip = skip_after
        elif not hidden:
            text = bytes.fromhex(hexed).decode(code_page, "ignore") if hexed else symbol if symbol in ("\\", "{", "}") else "\u00a0" if symbol == "~" else plain or ""
            out.append(text[skip:])
            skip = max(0, skip - len(text))
    return "".join(out)


def read_rtf(data: bytes) -> list[str]:
    return [_rtf_text(data.decode("latin-1"))]


def _cell_text(c: ET.Element, shared: list[str], dated: set[int]) -> str:
    kind, value = c.get("t"), next((e.text or "" for e in c if _local(e.tag) == "v"), "")
    if kind == "inlineStr":
        return "".join(e.text or "" for e in c.iter() if _local(e.tag) == "t")
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "True" if value == "1" else "False"
    if value and kind in (None, "n"):
        if int(c.get("s") or 0) in dated:
            return (datetime(1899, 12, 30) + timedelta(days=float(value))).strftime("%d.%m.%Y")
        return str(int(float(value))) if re.fullmatch(r"-?\d+(?:\.0+)?", value) else value
    return value


def read_xlsx(data: bytes) -> list[str]:
    """Saved values, a row a line with four spaces between cells; sheets named where there are several."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        tree = lambda n: ET.fromstring(z.read(n))
        shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in tree("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        dated: set[int] = set()
        if "xl/styles.xml" in names:
            styles = tree("xl/styles.xml")
            own = {int(e.get("numFmtId")) for e in styles.iter() if _local(e.tag) == "numFmt" and re.search(r"[dy]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", e.get("formatCode") or ""), re.I)}
            formats = next((e for e in styles if _local(e.tag) == "cellXfs"), ())
            dated = {i for i, x in enumerate(formats) if (f := int(x.get("numFmtId") or 0)) in own or 14 <= f <= 22 or 45 <= f <= 47}
        targets = {e.get("Id"): e.get("Target") for e in tree("xl/_rels/workbook.xml.rels")}
        sheets = [(e.get("name"), targets[_attribute(e, "id")]) for e in tree("xl/workbook.xml").iter() if _local(e.tag) == "sheet"]
        out = []
        for name, target in sheets:
            if len(sheets) > 1:
                out.append(f"=== Лист: {name} ===")
            for row in (e for e in tree("xl/" + target.removeprefix("/xl/")).iter() if _local(e.tag) == "row"):
                cells: dict[int, str] = {}
                for c in row:
                    letters = re.match(r"[A-Z]+", c.get("r") or "")
                    at = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters[0]))) if letters else len(cells) + 1
                    cells[at] = _cell_text(c, shared, dated)
                line = [cells.get(k, "") for k in range(1, max(cells, default=0) + 1)]
                while line and not line[-1]:
                    line.pop()
                if line:
                    out.append("    ".join(line))
    return ["\n".join(out)]


def read_pdf(data: bytes) -> list[str]:
    try:
        import fitz
    except ImportError as e:
        raise NotImplementedError("reading PDF needs the optional package PyMuPDF") from e
    with fitz.open(stream=data, filetype="pdf") as doc:
        return [page.get_text(sort=True) for page in doc]


READERS = {".txt": lambda d: [decode(d)], ".docx": read_docx, ".odt": read_odt, ".odg": read_odg, ".rtf": read_rtf, ".xlsx": read_xlsx, ".xlsm": read_xlsx, ".pdf": read_pdf}


def read_pages(files: DataFrame) -> DataFrame:
    """(doc_id, page_no, text, error) from files (doc_id, ext, content); a file that fails gives one row with the error's class."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for doc_id, ext, content in zip(f["doc_id"], f["ext"], f["content"], strict=True):
                try:
                    rows += [(doc_id, k, text, None) for k, text in enumerate(READERS[ext](bytes(content)), 1)]
                except Exception as e:  # noqa: BLE001 - a bad file fails alone, and is told by class only
                    rows.append((doc_id, 1, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "text", "error"])

    return files.select(F.col("doc_id").cast("long").alias("doc_id"), "ext", "content").mapInPandas(work, PAGE)
