"""What a run tells of its files: words for stages and states, durations, shares of workers, pages of rendered text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactrix.functions import patterns as P
from redactrix.functions.text import wrap_lines
from redactrix.operators.lines import dealt

DOT = "  ·  "
#: Dots an inch of a page that is recognised, and pixels of its longest side at most; least confidence of a page.
OCR_DPI, OCR_SIDE, OCR_CONFIDENCE = 180, 2200, 0.65


def _word(x: Column, words: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for pair in words.items() for v in pair])[x]


def short_stage(stage: Column) -> Column:
    return F.coalesce(_word(stage, P.STAGE_WORDS), F.lit("Анализ"))


def status_text(status: Column, stage: Column) -> Column:
    """A file's state in a word; while it is worked on, its stage."""
    return F.when((status == "active") & (stage != ""), short_stage(stage)).otherwise(_word(status, P.STATUS_WORDS))


def bare_badge(badge: Column, status: Column) -> Column:
    """A badge without what the state says already."""
    marks = F.filter(F.split(badge, DOT), lambda m: (m != "") & ~(status.isin("review", "failed") & (m == "проверить")))
    return F.array_join(marks, DOT)


def file_states(events: DataFrame, finished: bool = False) -> DataFrame:
    """(number, status, stage, badge) from events (number, seq, stage, outcome, badge): the last of each file; a badge stays until another comes.

    When the run is ``finished``, files still at work go back to waiting.
    """
    last = F.max_by(F.struct("stage", "outcome"), "seq").alias("last")
    badge = F.max_by(F.when(F.col("badge") != "", F.col("badge")), F.when(F.col("badge") != "", F.col("seq"))).alias("badge")
    status = F.when(F.col("last.outcome") != "", F.col("last.outcome")).otherwise("" if finished else "active")
    return events.groupBy("number").agg(last, badge).select("number", status.alias("status"), F.when(status == "active", F.col("last.stage")).otherwise("").alias("stage"), F.coalesce("badge", F.lit("")).alias("badge"))


def batch_state(successful: Column, needs_review: Column) -> Column:
    return F.when(successful == 0, "failed").when(needs_review > 0, "review").otherwise("done")


def plural(n: Column, one: str, few: str, many: str) -> Column:
    tail = F.abs(n) % 100
    return F.when(tail.between(11, 14), many).when(tail % 10 == 1, one).when((tail % 10).between(2, 4), few).otherwise(many)


def duration(seconds: Column) -> Column:
    """Minutes and seconds, with hours from one on."""
    total = F.greatest(F.lit(0), seconds.cast("long"))
    hours, minutes, rest = F.floor(total / 3600), F.floor(total / 60) % 60, total % 60
    return F.when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, rest)).otherwise(F.format_string("%02d:%02d", minutes, rest))


def summary(successful: Column, seconds: Column) -> Column:
    return F.concat(successful.cast("string"), F.lit(" "), plural(successful, "файл", "файла", "файлов"), F.lit(" за "), duration(seconds))


def breadcrumb(path: Column, home: Column, parts: int = 3) -> Column:
    """The last parts of a path, without the home folder; what is left out in front is an ellipsis. No parts: the path."""
    below = F.when(path.startswith(F.concat(home, F.lit("/"))), F.substr(path, F.length(home) + 2)).otherwise(path)
    names = F.filter(F.split(below, "/"), lambda x: x != "")
    shown = F.slice(names, F.greatest(F.size(names) - parts, F.lit(0)) + 1, parts)
    return F.when(F.size(names) == 0, path).otherwise(F.concat(F.when(F.size(names) > parts, "…  /  ").otherwise(""), F.array_join(shown, "  /  ")))


def worker_limits(ocr_jobs: Column, text_jobs: Column, cpus: Column, memory: Column) -> Column:
    """Workers for recognition and for text, so that neither CPUs nor memory are overbooked: struct (ocr, text)."""
    ocr = F.least(ocr_jobs, F.when((memory >= 12 * 1024**3) & (cpus >= 8), 2).otherwise(1))
    return F.struct(ocr.alias("ocr"), F.least(text_jobs, F.lit(4), F.greatest(F.lit(1), cpus - ocr * F.least(F.lit(4), cpus))).alias("text"))


def ocr_scale(width: Column, height: Column) -> Column:
    """How much a page is enlarged for recognition."""
    return F.least(F.lit(OCR_DPI / 72.0), F.lit(float(OCR_SIDE)) / F.greatest(width.cast("double"), height.cast("double"), F.lit(1.0)))


def ocr_confidence(scores: Column) -> Column:
    """The mean score of a page's fragments; 0 without any."""
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(scores) > 0, total / F.size(scores)).otherwise(F.lit(0.0))


def low_confidence(text: Column, confidence: Column) -> Column:
    return (text != "") & (confidence < OCR_CONFIDENCE)


def ocr_files(pages: DataFrame) -> DataFrame:
    """(doc_id, ocr) from pages (doc_id, kind, needs_ocr): pictures always, a PDF if a page needs it, others never."""
    return pages.groupBy("doc_id").agg(F.coalesce(F.bool_or((F.col("kind") == "image") | ((F.col("kind") == "pdf") & F.col("needs_ocr"))), F.lit(False)).alias("ocr"))


def rendered(pages: DataFrame, columns: int = 100, height: float = 842.0, size: float = 9.0, margin: float = 36.0) -> DataFrame:
    """(doc_id, sheet, text): pages (doc_id, page_no, text) wrapped at ``columns`` and cut into sheets as high as the paper.

    A page begins a sheet; a line goes to the next sheet where it would stand below the margin. Lines are set 1.35 sizes apart.
    """
    top, step, bottom, n = margin + size, size * 1.35, height - margin, 1
    while top + n * step <= bottom:
        n += 1
    lines = wrap_lines(F.col("text"), columns)
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("lines") / n), F.lit(1)).cast("int") - 1), lambda k: F.array_join(F.slice(F.col("lines"), k * n + 1, n), "\n"))
    sheets = F.sort_array(F.collect_list(F.struct("page_no", "sheets")))
    whole = dealt(pages.select("doc_id", "page_no", "text"), "doc_id").select("doc_id", "page_no", lines.alias("lines")).select("doc_id", "page_no", cut.alias("sheets")).groupBy("doc_id").agg(F.flatten(F.transform(sheets, lambda p: p["sheets"])).alias("all"))
    return whole.select("doc_id", F.posexplode("all").alias("sheet", "text")).withColumn("sheet", F.col("sheet") + 1)
