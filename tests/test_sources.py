"""Discovery, readers and reading order."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from redactrix.sources import files, readers


def test_discovery(spark, tmp_path):
    (tmp_path / "б").mkdir()
    for name in ("а.PDF", "б/скан.jpg", "б/.скрытый.pdf", "~$лок.docx", "в.txt", "г.zip", "_х.txt"):
        (tmp_path / name).write_text("x")
    (tmp_path / "ссылка.txt").symlink_to("/etc/hostname")
    found, skipped = files.discover(files.walk(spark, str(tmp_path)))
    assert [r["rel_path"] for r in found.orderBy("number").collect()] == ["_х.txt", "а.PDF", "б/скан.jpg", "в.txt"]
    assert [tuple(r) for r in skipped.collect()] == [(".zip", 1)]


RTF = rb"{\rtf1\ansi\ansicpg1251{\fonttbl x}\'cf\'f0\par " + b"\\" + b"u1080?}"


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml").replace("_rels", "_rels"), text)
    return out.getvalue()


def test_readers(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    docx = zipped(word__document_xml=f"<w:document {w}><w:body><w:p><w:r><w:t>Иванов</w:t><w:tab/><w:t>1</w:t></w:r></w:p><w:p><w:r><w:t>два</w:t></w:r></w:p></w:body></w:document>")
    t = 'xmlns:t="urn:text" xmlns:d="urn:draw" xmlns:s="urn:svg"'
    odt = zipped(content_xml=f"<r {t}><t:p>раз</t:p><t:p>два<t:tab/>три</t:p></r>")
    odg = zipped(content_xml=f'<r {t}><d:page><d:f s:x="1cm" s:y="2cm"><t:p>низ</t:p></d:f><d:f s:x="1cm" s:y="5mm"><t:p>верх</t:p></d:f></d:page></r>')
    rows = [(1, ".docx", docx), (2, ".odt", odt), (3, ".odg", odg), (4, ".txt", "Привет".encode("cp1251")), (5, ".rtf", RTF), (6, ".docx", b"broken")]
    got = {r["doc_id"]: r for r in readers.read_pages(spark.createDataFrame(rows, "doc_id long, ext string, content binary")).collect()}
    assert got[1]["text"] == "Иванов\t1\nдва"
    assert got[2]["text"] == "раз\nдва\tтри"
    assert got[3]["text"] == "верх\nниз"
    assert got[4]["text"] == "Привет"
    assert got[5]["text"].split("\n") == ["Пр", "и"]
    assert got[6]["error"] == "BadZipFile" and got[6]["text"] is None


def test_output_folder(tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    assert files.output_folder(str(src), "t") == str(tmp_path / "Обезличенные")
    (tmp_path / "Обезличенные").mkdir()
    assert files.output_folder(str(src), "t") == str(tmp_path / "Обезличенные_t")


def test_reading_order(spark):
    boxes = spark.createDataFrame([(1, 1, "б", 50.0, 10.0, 10.0, 15.0), (1, 1, "а", 5.0, 12.0, 10.0, 17.0), (1, 1, "в", 5.0, 60.0, 10.0, 65.0)], "doc_id long, page_no int, text string, left double, top double, height double, center double")
    assert files.reading_order(boxes).first()["text"] == "а  б\nв"


@pytest.mark.parametrize(("text", "images", "coverage", "need"), [("", True, 0.0, True), ("", False, 0.0, False), ("мало", True, 0.5, True), ("мало", True, 0.1, False)])
def test_needs_ocr(spark, text, images, coverage, need):
    assert spark.range(1).select(files.needs_ocr(F.lit(text), F.lit(images), F.lit(coverage))).first()[0] is need
