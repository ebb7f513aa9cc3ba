"""Results of files: outcome, badges, counts and a report without names or text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactrix.functions import patterns as P

REVIEW, DOT = "проверить", "  ·  "
OTHER = "другие расширения"


def _some(c: str) -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False))


def needs_review() -> Column:
    return _some("scan_pages") | _some("ocr_pages") | _some("low_confidence_pages") | _some("findings") | F.col("error").isNotNull()


def outcome() -> Column:
    return F.when(F.col("error").isNotNull(), "failed").when(_some("low_confidence_pages") | _some("findings") | _some("scan_pages"), "review").otherwise("done")


def badge() -> Column:
    return F.concat_ws(DOT, F.when(_some("ocr_pages"), "OCR"), F.when(_some("low_confidence_pages") | _some("findings"), REVIEW))


def code(number: Column) -> Column:
    return F.format_string("document_%04d", number.cast("int"))


def removed_image_pages() -> Column:
    return F.array_sort(F.array_except(F.array_except("image_pages", "ocr_pages"), "scan_pages"))


def totals(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count_if(F.col("output_path").isNotNull()).alias("successful"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_if(_some("ocr_pages")).alias("ocr_documents"),
        F.coalesce(F.sum(F.size("ocr_pages")), F.lit(0)).cast("long").alias("ocr_pages"), F.count_if(needs_review()).alias("needs_review"),
    )


def kinds_of(found: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda f: f["kind"]))), ", ")


def warnings(results: DataFrame) -> DataFrame:
    """(number, position, line): up to six warnings of each file, in order."""
    pages = lambda c: F.array_join(F.transform(c, lambda p: p.cast("string")), ", ")
    shown = [
        F.when(F.col("error").isNotNull(), F.concat(F.lit("ошибка: "), F.col("error"))),
        F.when(_some("scan_pages"), F.concat(F.lit("страницы без текста: "), pages(F.col("scan_pages")))),
        F.when(_some("ocr_pages"), F.concat(F.lit("распознаны: "), pages(F.col("ocr_pages")))),
        F.when(_some("low_confidence_pages"), F.concat(F.lit("низкая уверенность: "), pages(F.col("low_confidence_pages")))),
        F.when(F.size(removed_image_pages()) > 0, F.concat(F.lit("удалены изображения: "), pages(removed_image_pages()))),
        F.when(_some("findings"), F.concat(F.lit("остались данные: "), kinds_of(F.col("findings")))),
    ]
    some = F.filter(F.array(*shown), lambda x: x.isNotNull())
    out = results.select("number", F.posexplode(some).alias("position", "line"))
    return out.select("number", "position", F.concat(code(F.col("number")), F.lit(": "), F.col("line")).alias("line"))


def safe_extension(ext: Column) -> Column:
    """An extension that can be shown as it is, or a common name for the others."""
    return F.when(ext.rlike(r"^\.[a-z0-9][a-z0-9+_-]{0,9}\z"), ext).otherwise(OTHER)


def skipped_histogram(skipped: DataFrame) -> DataFrame:
    return skipped.groupBy(safe_extension(F.col("ext")).alias("ext")).agg(F.sum("n").cast("long").alias("n"))


def safe_error(kind: Column, message: Column) -> Column:
    """An error told without paths or names."""
    low = F.lower(message)
    return (
        F.when(kind == "PermissionError", "нет доступа к файлу").when(kind == "FileNotFoundError", "файл недоступен").when(kind == "BadZipFile", "повреждённый офисный документ").when(kind == "OCRError", message)
        .when(low.contains("password") | low.contains("encrypted"), "документ защищён паролем").when(low.contains("cannot open") | low.contains("invalid") | low.contains("format"), "не удалось прочитать формат документа")
        .otherwise(F.concat(F.lit("ошибка обработки ("), kind, F.lit(")")))
    )


def percent(completed: Column, total: Column, fraction: Column, overall: Column) -> Column:
    """Progress in whole percent (halves to even): 1 to 99 while a file is under way, 0 to 100 else."""
    raw = F.when(overall.isNotNull(), overall * 100).when(total == 0, 0.0).otherwise((completed + fraction) * 100 / total)
    n = F.bround(raw, 0).cast("int")
    going = (completed < total) & (fraction > 0)
    return F.when(going, F.greatest(F.lit(1), F.least(F.lit(99), n))).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), n)))


def phase_fraction(phase: Column, done: Column, total: Column) -> Column:
    table = F.create_map(*[x for k, (start, span) in P.PHASES.items() for x in (F.lit(k), F.array(F.lit(start), F.lit(span)))])
    return table[phase][0] + table[phase][1] * F.when(total == 0, 1.0).otherwise(done / total)


def monotone(events: DataFrame) -> DataFrame:
    """Events (seq, number, fraction) with each file's largest fraction so far."""
    w = Window.partitionBy("number").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("so_far", F.max("fraction").over(w))


def eta(seconds: Column, done: Column) -> Column:
    return F.when(done.between(2, 99) & (seconds >= 3), F.bround(seconds * (100 - done) / done, 0).cast("long"))


def throttled(n: Column, total: Column, events: int = 100) -> Column:
    """Which of a stage's steps to tell of: the first, the last, and about ``events`` between."""
    return (n == 1) | (n == total) | (n % F.greatest(F.lit(1), F.floor(total / events)) == 0)


def stage_seconds(events: DataFrame) -> DataFrame:
    """(number, stage, seconds) from events (number, ts, stage): time until the next event, by stage."""
    w = Window.partitionBy("number").orderBy("ts", "seq")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    spent = F.lead(at).over(w) - at
    return events.withColumn("spent", F.coalesce(spent, F.lit(0))).groupBy("number", "stage").agg((F.sum("spent") / 1e6).alias("seconds"))


def compare_baseline(now: DataFrame, before: DataFrame, fields: list[str]) -> DataFrame:
    """(number, changed, speedup) of files against an earlier run, fields compared with nulls equal."""
    b = before.select("number", *[F.col(f).alias(f"b_{f}") for f in fields], F.col("seconds").alias("b_seconds"))
    changed = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"b_{f}")), F.lit(f)) for f in fields]))
    return now.join(b, "number", "left").select("number", F.array_join(changed, ",").alias("changed"), F.bround(F.col("b_seconds") / F.nullif(F.col("seconds"), F.lit(0.0)), 3).alias("speedup"))
