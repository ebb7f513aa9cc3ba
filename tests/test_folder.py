"""A run over a folder of files, from discovery to the report."""

import os
import stat

from redactrix.plans import folder


def test_folder_run(spark, tmp_path):
    source = tmp_path / "архив +1"
    (source / "Ковалёв").mkdir(parents=True)
    (source / "Ковалёв" / "а.txt").write_text("Выписка. Ковалёву назначено лечение\nТелефон: +7 900 123-45-67", "utf-8")
    (source / "б.docx").write_bytes(b"no archive")
    (source / "в.zip").write_bytes(b"x")
    out = folder.process_folder(spark, str(source), "2026-01-01")
    names = sorted(os.listdir(out))
    assert names == ["document_0001.txt", "Отчет.txt"] or names == ["document_0002.txt", "Отчет.txt"]
    text = (tmp_path / "Обезличенные" / names[0]).read_text("utf-8")
    assert text == "Выписка. [FIO] назначено лечение\nТелефон: [PHONE]"
    told = (tmp_path / "Обезличенные" / "Отчет.txt").read_text("utf-8-sig")
    assert "Обработано: 1" in told and "С ошибкой: 1" in told and ".zip: 1" in told and "Ковалёв" not in told and "б.docx" not in told
    assert stat.S_IMODE(os.stat(out).st_mode) == 0o700 and stat.S_IMODE(os.stat(f"{out}/{names[0]}").st_mode) == 0o600
    assert not any(n.endswith(".part") for n in os.listdir(tmp_path))
