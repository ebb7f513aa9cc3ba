"""A run over a folder: files are found, read, masked and audited; clean texts and a report without personal data go to a new folder."""

from __future__ import annotations

import os
import shutil
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactrix.operators import report
from redactrix.plans.deidentify import audited, deidentify
from redactrix.sources import files, readers

REPORT = "Отчет.txt"


def file_results(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, texts, skipped) of a folder: a row a file, a clean text a file that could be read, extensions left out."""
    found, skipped = files.discover(files.walk(spark, folder))
    raw = spark.read.format("binaryFile").load([str(Path(folder).resolve() / r["rel_path"]) for r in found.collect()]) if not found.isEmpty() else spark.createDataFrame([], "path string, content binary")
    root = str(Path(folder).resolve())
    path = F.regexp_replace(F.expr("url_decode(replace(path, '+', '%2B'))"), r"^file:/+", "/")
    read = raw.select(F.substr(path, F.lit(len(root) + 2)).alias("rel_path"), "content").join(found, "rel_path").select(F.col("number").cast("long").alias("doc_id"), "ext", "content")
    pages = readers.read_pages(read).persist()
    clean = deidentify(pages.filter("error is null").select("doc_id", "page_no", "text"), paths=found.select(F.col("number").cast("long").alias("doc_id"), F.col("rel_path").alias("path"))).persist()
    texts = clean.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"]), "\n").alias("text"))
    failed = pages.filter("error is not null").groupBy("doc_id").agg(F.first("error").alias("kind"))
    left = audited(clean).groupBy("doc_id").agg(F.collect_list(F.struct("kind", "snippet")).alias("findings"))
    none = F.array().cast("array<int>")
    out = found.select(F.col("number").cast("long").alias("number"), "rel_path").join(failed, F.col("number") == failed["doc_id"], "left").drop("doc_id").join(left, F.col("number") == left["doc_id"], "left").drop("doc_id")
    return out.select(
        "number", "rel_path", F.when(F.col("kind").isNull(), F.concat(report.code(F.col("number")), F.lit(".txt"))).alias("output_path"), F.when(F.col("kind").isNotNull(), report.safe_error(F.col("kind"), F.lit(""))).alias("error"),
        none.alias("scan_pages"), none.alias("image_pages"), none.alias("ocr_pages"), none.alias("low_confidence_pages"), F.coalesce("findings", F.array().cast("array<struct<kind:string,snippet:string>>")).alias("findings"),
    ), texts, report.skipped_histogram(skipped)


def report_lines(results: DataFrame, skipped: DataFrame) -> list[str]:
    """Counts, warnings in order of files, and extensions left out: no names of files and no findings."""
    t = report.totals(results).first()
    out = [f"Обработано: {t['successful']}", f"С ошибкой: {t['failed']}", f"Требуют проверки: {t['needs_review']}", f"Распознано: {t['ocr_documents']} ({t['ocr_pages']})", ""]
    out += [r["line"] for r in report.warnings(results).orderBy("number", "position").toLocalIterator()]
    return [*out, *(f"пропущено {r['ext']}: {r['n']}" for r in skipped.orderBy("ext").toLocalIterator())]


def process_folder(spark: SparkSession, folder: str, stamp: str | None = None) -> str:
    """Writes document_0001.txt ... and a report beside the folder, and returns the new folder's path.

    The new folder is there whole or not at all: it is made under another name and renamed at the end; only its
    owner can read it. A file that cannot be read is told in the report and stops nothing. Texts come to the driver
    one after another, as the files of a desktop folder do; larger collections use ``deidentify`` on tables.
    """
    target = files.output_folder(folder, stamp or time.strftime("%Y-%m-%d_%H-%M-%S"))
    part = f"{target}.part"
    os.makedirs(part, mode=0o700)
    try:
        results, texts, skipped = file_results(spark, folder)
        for row in texts.orderBy("doc_id").toLocalIterator():
            _write(part, f"document_{row['doc_id']:04d}.txt", row["text"])
        _write(part, REPORT, "\n".join(report_lines(results, skipped)), "utf-8-sig")
        os.rename(part, target)
    except BaseException:
        shutil.rmtree(part, ignore_errors=True)
        raise
    return target


def _write(folder: str, name: str, text: str, encoding: str = "utf-8") -> None:
    with open(os.open(os.path.join(folder, name), os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w", encoding=encoding, newline="") as f:
        f.write(text)
