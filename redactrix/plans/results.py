"""Queries over files, results and progress, made from the tables' keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactrix.operators import report
from redactrix.plans.constructed import by_case, orders, pick
from redactrix.plans.real_text import table
from redactrix.sources import files

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


EXTENSIONS = (".txt", ".PDF", ".docx", ".zip", "", ".jpg", ".Иванов", ".xlsx")
_X = "(['.txt', '.PDF', '.docx', '.zip', '', '.jpg', '.Иванов', '.xlsx'])[p_partkey % 8 + 1]"
_DIR = "(['А/', 'б/', '.скрытая/'])[p_partkey % 3 + 1]"


def listed(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat(by_case(k % 11, F.lit("~$файл"), *[F.lit("файл")] * 10), k.cast("string"), pick(EXTENSIONS, k))
    return table(spark, sf_dir, "part").select(F.concat(pick(("А/", "б/", ".скрытая/"), k), name).alias("rel_path"), files.extension(name).alias("ext"), k.alias("size"))


_SEEN = f"WITH s AS (SELECT {_DIR} || 'файл' || p_partkey || {_X} AS rel_path, lower({_X}) AS ext FROM part WHERE p_partkey % 3 <> 2 AND p_partkey % 11 <> 0)"


@query(f"{_SEEN} SELECT rel_path, (row_number() OVER (ORDER BY lower(rel_path), rel_path))::INT AS number FROM s WHERE ext IN ('.txt', '.pdf', '.docx', '.jpg', '.xlsx')")
def file_numbering(spark, sf_dir):
    return files.discover(listed(spark, sf_dir))[0].select("rel_path", "number")


@query(f"{_SEEN} SELECT CASE WHEN ext = '.zip' THEN ext ELSE 'другие расширения' END AS ext, count(*)::BIGINT AS n FROM s WHERE ext IN ('.zip', '', '.иванов') GROUP BY 1")
def skipped_ext_histogram(spark, sf_dir):
    return report.skipped_histogram(files.discover(listed(spark, sf_dir))[1])


@query("SELECT min(p_partkey)::BIGINT AS position, 'в/' || (p_partkey // 2) || '.txt' AS rel_path, '.txt' AS ext FROM part WHERE p_partkey % 4 < 2 GROUP BY p_partkey // 2")
def manifest_dedup(spark, sf_dir):
    k = F.col("p_partkey")
    inside = F.concat(F.lit("в/"), F.floor(k / 2).cast("string"), F.lit(".txt"))
    path = F.when(k % 4 < 2, F.concat(F.when(k % 2 == 0, F.lit("./")).otherwise(""), inside)).when(k % 4 == 2, F.concat(F.lit("../"), inside)).otherwise(F.concat(F.lit("в/"), k.cast("string"), F.lit(".exe")))
    return files.manifest(table(spark, sf_dir, "part").select(k.alias("position"), path.alias("rel_path")))


@query(f"SELECT p_partkey AS k, (['text', 'pdf', 'doc', 'text', 'text', 'image', 'text', 'sheet'])[p_partkey % 8 + 1] AS kind FROM part")
def file_kind(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("k"), files.kind(F.lower(pick(EXTENSIONS, k))).alias("kind"))


def results(spark, sf_dir) -> DataFrame:
    """A result for each order, pages and findings by its key."""
    k = F.col("k")
    some = lambda m, *pages: F.when(k % m == 0, F.array(*[F.lit(p) for p in pages])).otherwise(F.array().cast("array<int>"))
    finding = F.struct(F.lit("EMAIL").alias("kind"), F.lit("x").alias("snippet"))
    other = F.struct(F.lit("ИНН").alias("kind"), F.lit("y").alias("snippet"))
    return orders(spark, sf_dir).select(
        k.alias("number"), F.when(k % 5 != 0, "out").alias("output_path"), F.when(k % 5 == 0, "файл недоступен").alias("error"), some(7, 1).alias("scan_pages"), some(2, 1, 2, 3, 9).alias("image_pages"),
        some(3, 2, 3).alias("ocr_pages"), some(11, 3).alias("low_confidence_pages"), F.when(k % 13 == 0, F.array(other, finding, finding)).otherwise(F.array().cast("array<struct<kind:string,snippet:string>>")).alias("findings"),
    )


@query("""
SELECT outcome, count(*) AS files, count(*) FILTER (WHERE review) AS review FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'failed' WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 7 = 0 THEN 'review' ELSE 'done' END AS outcome,
  o_orderkey % 5 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 3 = 0 AS review FROM orders) GROUP BY outcome
""")
def file_outcome_rollup(spark, sf_dir):
    return results(spark, sf_dir).groupBy(report.outcome().alias("outcome")).agg(F.count("*").alias("files"), F.count_if(report.needs_review()).alias("review"))


@query("""
SELECT count(*) FILTER (WHERE o_orderkey % 5 <> 0) AS successful, count(*) FILTER (WHERE o_orderkey % 5 = 0) AS failed, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS ocr_documents, (2 * count(*) FILTER (WHERE o_orderkey % 3 = 0))::BIGINT AS ocr_pages,
  count(*) FILTER (WHERE o_orderkey % 5 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 3 = 0) AS needs_review FROM orders
""")
def batch_totals(spark, sf_dir):
    return report.totals(results(spark, sf_dir))


@query("SELECT o_orderkey AS number, CASE WHEN o_orderkey % 2 <> 0 THEN [] ELSE list_filter([1, 2, 3, 9], lambda p: NOT (o_orderkey % 7 = 0 AND p = 1) AND NOT (o_orderkey % 3 = 0 AND p IN (2, 3))) END AS pages FROM orders")
def removed_image_pages(spark, sf_dir):
    return results(spark, sf_dir).select("number", report.removed_image_pages().alias("pages"))


@query("""
WITH r AS (SELECT o_orderkey AS number, list_filter([CASE WHEN o_orderkey % 5 = 0 THEN 'ошибка: файл недоступен' END, CASE WHEN o_orderkey % 7 = 0 THEN 'страницы без текста: 1' END, CASE WHEN o_orderkey % 3 = 0 THEN 'распознаны: 2, 3' END,
  CASE WHEN o_orderkey % 11 = 0 THEN 'низкая уверенность: 3' END, CASE WHEN o_orderkey % 2 = 0 THEN 'удалены изображения: ' || CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE '1, ' END || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '2, 3, ' END || '9' END,
  CASE WHEN o_orderkey % 13 = 0 THEN 'остались данные: EMAIL, ИНН' END], lambda x: x IS NOT NULL) AS l FROM orders),
u AS (SELECT number, unnest(l) AS line, unnest(range(0, len(l))) AS position FROM r)
SELECT number, position::INT AS position, printf('document_%04d', number) || ': ' || line AS line FROM u
""")
def report_warnings(spark, sf_dir):
    return report.warnings(results(spark, sf_dir))


@query("SELECT o_orderkey AS number, CASE WHEN o_orderkey % 3 = 0 AND (o_orderkey % 11 = 0 OR o_orderkey % 13 = 0) THEN 'OCR  ·  проверить' WHEN o_orderkey % 3 = 0 THEN 'OCR' WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN 'проверить' ELSE '' END AS badge FROM orders")
def badge(spark, sf_dir):
    return results(spark, sf_dir).select("number", report.badge().alias("badge"))


@query("SELECT p_partkey AS k, (['нет доступа к файлу', 'файл недоступен', 'повреждённый офисный документ', 'документ защищён паролем', 'не удалось прочитать формат документа', 'ошибка обработки (KeyError)'])[p_partkey % 6 + 1] AS told FROM part")
def safe_errors(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("k"), report.safe_error(pick(("PermissionError", "FileNotFoundError", "BadZipFile", "ValueError", "RuntimeError", "KeyError"), k), pick(("x", "x", "x", "Password needed", "cannot open file", "имя пациента"), k)).alias("told"))


def _progress(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("number"), "event_type", (F.col("event_id") % 21).cast("long").alias("completed"), (F.col("event_id") % 4 / 4.0).alias("fraction"))


_PCT = "round_even(CASE WHEN event_id % 5 = 0 THEN ((event_id % 8) / 8.0::DOUBLE) * 100 ELSE (event_id % 21 + (event_id % 4) / 4.0::DOUBLE) * 100 / 20 END, 0)::INT"


@query(f"SELECT event_id, CASE WHEN event_id % 21 < 20 AND event_id % 4 > 0 THEN greatest(1, least(99, {_PCT})) ELSE greatest(0, least(100, {_PCT})) END::INT AS percent FROM events")
def progress_percent(spark, sf_dir):
    overall = F.when(F.col("event_id") % 5 == 0, F.col("event_id") % 8 / 8.0)
    return _progress(spark, sf_dir).select("event_id", report.percent(F.col("completed"), F.lit(20), F.col("fraction"), overall).alias("percent"))


@query("SELECT event_id, max((event_id % 4) / 4.0::DOUBLE) OVER (PARTITION BY user_id ORDER BY event_id) AS so_far FROM events")
def progress_monotone(spark, sf_dir):
    return report.monotone(_progress(spark, sf_dir).withColumn("seq", F.col("event_id"))).select("event_id", "so_far")


@query("""
WITH e AS (SELECT user_id, event_type, coalesce(epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts), 0) AS spent FROM events)
SELECT user_id AS number, event_type AS stage, sum(spent)::DOUBLE / 1e6::DOUBLE AS seconds FROM e GROUP BY ALL
""")
def stage_seconds(spark, sf_dir):
    return report.stage_seconds(_progress(spark, sf_dir).withColumn("seq", F.col("event_id")).withColumn("stage", F.col("event_type")))


@query("SELECT event_id, CASE WHEN event_id % 101 BETWEEN 2 AND 99 AND event_id % 50 >= 3 THEN round_even((event_id % 50) * (100 - event_id % 101) / (event_id % 101)::DOUBLE, 0)::BIGINT END AS eta FROM events")
def eta(spark, sf_dir):
    return _progress(spark, sf_dir).select("event_id", report.eta((F.col("event_id") % 50).cast("double"), F.col("event_id") % 101).alias("eta"))


@query("SELECT event_id, event_id % 1000 = 1 OR event_id % 1000 = 999 OR (event_id % 1000) % 9 = 0 AS told FROM events")
def progress_throttle(spark, sf_dir):
    return _progress(spark, sf_dir).select("event_id", report.throttled(F.col("event_id") % 1000, F.lit(999)).alias("told"))


@query("SELECT event_id, CASE event_id % 2 WHEN 0 THEN 0.05::DOUBLE + 0.48::DOUBLE * ((event_id % 10) / 10.0::DOUBLE) ELSE 0.89::DOUBLE + 0.09::DOUBLE * ((event_id % 10) / 10.0::DOUBLE) END AS fraction FROM events")
def phase_fractions(spark, sf_dir):
    return _progress(spark, sf_dir).select("event_id", report.phase_fraction(pick(("ocr", "audit"), F.col("event_id")), (F.col("event_id") % 10).cast("double"), F.lit(10)).alias("fraction"))


@query("SELECT l_orderkey AS doc_id, 1 AS page_no, string_agg(l_partkey || '  ' || l_suppkey, chr(10) ORDER BY l_linenumber) AS text FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL) GROUP BY l_orderkey")
def ocr_reading_order(spark, sf_dir):
    once = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    top = F.col("l_linenumber") * 30.0
    box = lambda text, left, lift: F.struct(text.cast("string").alias("text"), F.lit(left).alias("left"), (top + lift).alias("top"), F.lit(10.0).alias("height"), (top + lift + 5).alias("center"))
    boxes = once.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_no"), F.explode(F.array(box(F.col("s"), 200.0, 0.0), box(F.col("p"), 10.0, 2.0))).alias("b")).select("doc_id", "page_no", "b.*")
    return files.reading_order(boxes)


@query("SELECT p_partkey AS k, p_size * (CASE p_partkey % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 10.0::DOUBLE WHEN 2 THEN 25.4::DOUBLE ELSE 1.0::DOUBLE END) AS mm FROM part")
def drawing_lengths(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("k"), files.millimetres(F.concat(F.col("p_size").cast("string"), pick(("mm", "cm", "in", "xx"), k))).alias("mm"))


@query("""
WITH o AS (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber FROM lineitem), d AS (SELECT l_orderkey AS doc_id, l_linenumber % 3 AS xref FROM o GROUP BY ALL), c AS (SELECT doc_id, least(1.0::DOUBLE, count(*) * 0.3::DOUBLE) AS coverage FROM d GROUP BY doc_id)
SELECT doc_id, coverage, CASE WHEN doc_id % 2 = 0 THEN true ELSE coverage >= 0.35 END AS needs_ocr FROM c
""")
def image_coverage_ocr(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_no"), (F.col("l_linenumber") % 3).alias("xref"), F.lit(3.0).alias("w"), F.lit(1.0).alias("h"), F.lit(10.0).alias("page_w"), F.lit(1.0).alias("page_h"))
    found = files.image_coverage(items)
    words = F.when(F.col("doc_id") % 2 == 0, "").otherwise("несколько слов")
    return found.select("doc_id", F.round("coverage", 9).alias("coverage"), files.needs_ocr(words, F.lit(True), F.round("coverage", 9)).alias("needs_ocr"))


@query("SELECT o_orderkey AS number, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'sha256' ELSE 'pages,sha256' END AS changed, CASE WHEN o_orderkey % 4 <> 0 THEN 2.0::DOUBLE END AS speedup FROM orders")
def baseline_compare(spark, sf_dir):
    k = F.col("k")
    now = orders(spark, sf_dir).select(k.alias("number"), F.lit(3).alias("pages"), F.lit("a").alias("sha256"), F.lit(10.0).alias("seconds"))
    before = orders(spark, sf_dir).select(k.alias("number"), F.when(k % 3 == 2, F.lit(None).cast("int")).otherwise(3).alias("pages"), F.when(k % 3 == 0, "a").otherwise("b").alias("sha256"), F.when(k % 4 != 0, 20.0).alias("seconds"))
    return report.compare_baseline(now, before, ["pages", "sha256"])
