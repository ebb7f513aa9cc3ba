"""Queries over states and words of a run, predicates of names and numbers, and line masks, made from the tables' keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from redactrix.functions import names
from redactrix.functions import patterns as P
from redactrix.operators import masks, memory, status
from redactrix.operators.context import dob_neighbour
from redactrix.operators.lines import page_window
from redactrix.plans.constructed import PHRASE, by_case, customers, order_lines, pick
from redactrix.plans.real_text import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))


def _list(values) -> str:
    return "['" + "', '".join(values) + "']"


STAGES = (*P.STAGE_WORDS, "иное")


@query(f"SELECT p_partkey AS k, ({_list([*P.STAGE_WORDS.values(), 'Анализ'])})[p_partkey % {len(STAGES)} + 1] AS word, ({_list(P.STATUS_WORDS.values())})[p_partkey % 5 + 1] AS state FROM part")
def status_words(spark, sf_dir):
    k = F.col("k")
    return _parts(spark, sf_dir).select("k", status.status_text(F.lit("active"), pick(STAGES, k)).alias("word"), status.status_text(pick(tuple(P.STATUS_WORDS), k), F.lit("")).alias("state"))


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN 'OCR' WHEN p_partkey % 2 = 0 THEN 'OCR' ELSE 'OCR  ·  проверить' END AS badge FROM part")
def bare_badges(spark, sf_dir):
    k = F.col("k")
    return _parts(spark, sf_dir).select("k", status.bare_badge(pick(("", "OCR", "OCR  ·  проверить"), k), pick(("review", "done"), k)).alias("badge"))


@query("""
WITH e AS (SELECT user_id AS number, event_id, CASE WHEN event_id % 3 = 0 THEN 'done' ELSE '' END AS outcome, CASE WHEN event_id % 4 = 0 THEN 'OCR' ELSE '' END AS badge, 'Чтение документа' AS stage FROM events),
l AS (SELECT number, arg_max(outcome, event_id) AS outcome, max(badge) AS badge FROM e GROUP BY number)
SELECT number, CASE WHEN outcome = '' THEN 'active' ELSE outcome END AS status, CASE WHEN outcome = '' THEN 'Чтение документа' ELSE '' END AS stage, badge FROM l
""")
def file_states(spark, sf_dir):
    e = F.col("event_id")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("number"), e.alias("seq"), F.lit("Чтение документа").alias("stage"), F.when(e % 3 == 0, "done").otherwise("").alias("outcome"), F.when(e % 4 == 0, "OCR").otherwise("").alias("badge"))
    return status.file_states(events)


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'failed' WHEN p_partkey % 2 = 1 THEN 'review' ELSE 'done' END AS state FROM part")
def batch_states(spark, sf_dir):
    return _parts(spark, sf_dir).select("k", status.batch_state(F.col("k") % 3, F.col("k") % 2).alias("state"))


_TIME = "CASE WHEN p_partkey * 7 >= 3600 THEN (p_partkey * 7 // 3600) || ':' || lpad((p_partkey * 7 // 60 % 60)::VARCHAR, 2, '0') ELSE lpad((p_partkey * 7 // 60)::VARCHAR, 2, '0') END || ':' || lpad((p_partkey * 7 % 60)::VARCHAR, 2, '0')"


@query(f"SELECT p_partkey AS k, p_partkey || CASE WHEN p_partkey % 100 BETWEEN 11 AND 14 THEN ' файлов' WHEN p_partkey % 10 = 1 THEN ' файл' WHEN p_partkey % 10 BETWEEN 2 AND 4 THEN ' файла' ELSE ' файлов' END || ' за ' || {_TIME} AS summary FROM part")
def batch_summary(spark, sf_dir):
    return _parts(spark, sf_dir).select("k", status.summary(F.col("k"), F.col("k") * 7).alias("summary"))


@query("SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'a  /  b' || p_partkey WHEN 1 THEN '…  /  b  /  c  /  d' || p_partkey ELSE 'srv  /  x' || p_partkey END AS trail FROM part")
def breadcrumbs(spark, sf_dir):
    k = F.col("k").cast("string")
    path = by_case(F.col("k"), F.concat(F.lit("/home/u/a/b"), k), F.concat(F.lit("/home/u/a/b/c/d"), k), F.concat(F.lit("/srv/x"), k))
    return _parts(spark, sf_dir).select("k", status.breadcrumb(path, F.lit("/home/u")).alias("trail"))


@query("""
WITH w AS (SELECT p_partkey AS k, least(p_partkey % 5, CASE WHEN p_partkey % 32 >= 12 AND p_partkey % 16 + 1 >= 8 THEN 2 ELSE 1 END)::INT AS ocr, (p_partkey % 16 + 1)::INT AS c FROM part)
SELECT k, ocr, least(k % 7, 4, greatest(1, c - ocr * least(4, c)))::INT AS text FROM w
""")
def worker_limits(spark, sf_dir):
    k = F.col("k")
    w = status.worker_limits((k % 5).cast("int"), (k % 7).cast("int"), (k % 16 + 1).cast("int"), (k % 32).cast("long") * 1024**3)
    return _parts(spark, sf_dir).select("k", w.alias("w")).select("k", F.col("w.ocr").cast("int").alias("ocr"), F.col("w.text").cast("int").alias("text"))


@query("SELECT p_partkey AS k, least(2.5::DOUBLE, 2200.0::DOUBLE / greatest(p_partkey::DOUBLE, 1.0::DOUBLE)) AS scale, CASE WHEN p_partkey % 3 = 0 THEN 0.0::DOUBLE ELSE (0.5::DOUBLE + 0.75::DOUBLE) / 2 END AS confidence, p_partkey % 3 <> 0 AS low FROM part")
def recognition_numbers(spark, sf_dir):
    k = F.col("k")
    scores = F.when(k % 3 == 0, F.array().cast("array<double>")).otherwise(F.array(F.lit(0.5), F.lit(0.75)))
    confidence = status.ocr_confidence(scores)
    return _parts(spark, sf_dir).select("k", status.ocr_scale(k, F.lit(1)).alias("scale"), confidence.alias("confidence"), status.low_confidence(F.when(k % 3 == 0, "").otherwise("текст"), confidence).alias("low"))


@query("SELECT l_orderkey AS doc_id, bool_or(l_orderkey % 3 = 0 OR (l_orderkey % 3 = 1 AND l_linenumber % 4 = 0)) AS ocr FROM lineitem GROUP BY l_orderkey")
def recognised_files(spark, sf_dir):
    k = F.col("l_orderkey")
    return status.ocr_files(table(spark, sf_dir, "lineitem").select(k.alias("doc_id"), pick(("image", "pdf", "text"), k).alias("kind"), (F.col("l_linenumber") % 4 == 0).alias("needs_ocr")))


@query("SELECT c_custkey AS doc_id, greatest(1, ceil((c_custkey % 200 + 1) / 63.0))::INT AS sheets, (c_custkey % 200 + 1)::INT AS lines FROM customer")
def rendered_sheets(spark, sf_dir):
    text = F.array_join(F.transform(F.sequence(F.lit(0), (F.col("k") % 200).cast("int")), lambda i: F.concat(F.lit("строка "), i.cast("string"))), "\n")
    sheets = status.rendered(customers(spark, sf_dir).select(F.col("k").alias("doc_id"), F.lit(1).alias("page_no"), text.alias("text")))
    return sheets.groupBy("doc_id").agg(F.count("*").cast("int").alias("sheets"), F.sum(F.size(F.split("text", "\n"))).cast("int").alias("lines"))


@query("""
SELECT c_custkey AS k, c_custkey % 5 IN (0, 3) AS clinical, c_custkey % 5 IN (1, 4) AS strong, c_custkey % 5 IN (1, 4) AS namelike, c_custkey % 5 IN (1, 4) AS sweepable FROM customer
""")
def name_predicates(spark, sf_dir):
    x = by_case(F.col("k"), F.lit("Узи"), F.lit("Ковалёва"), F.lit("осмотр"), F.lit("Рентгенография"), F.lit("Сергей"))
    plain = F.lower(x)
    return customers(spark, sf_dir).select("k", names.has_clinical_word(x).alias("clinical"), names.is_strong_name(x).alias("strong"), names.is_namelike(x).alias("namelike"), names.is_sweepable(plain, F.lit(False)).alias("sweepable"))


@query("SELECT c_custkey AS k, c_custkey % 3 = 0 AS card FROM customer")
def card_number_lines(spark, sf_dir):
    k = F.col("k")
    x = by_case(k, F.concat(F.lit("№ 123/"), k.cast("string")), F.concat(F.lit("номер телефона 12345"), k.cast("string")), F.lit("№ 12"))
    return customers(spark, sf_dir).select("k", names.is_card_number_line(x).alias("card"))


_L = "WITH l AS (SELECT o_custkey AS doc_id, o_orderkey AS k, (o_orderkey * 31 + o_custkey) % 8 AS c FROM orders)"


_NEAR = "max(CASE WHEN c = 4 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN"


@query(f"{_L} SELECT doc_id, k, coalesce({_NEAR} 4 PRECEDING AND 1 PRECEDING), 0) + coalesce({_NEAR} 1 FOLLOWING AND 4 FOLLOWING), 0) > 0 AS near FROM l")
def dob_neighbour_window(spark, sf_dir):
    lines = order_lines(spark, sf_dir)
    for c, word in (("core", "Возраст"), ("norm", "Возраст"), ("lower", "возраст")):
        lines = lines.withColumn(c, F.when(F.lower(c) == "паспорт", word).otherwise(F.col(c)))
    return lines.select("doc_id", "k", dob_neighbour(page_window("doc_id")).alias("near"))


@query("""
SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN 'Место работы: [WORKPLACE]' WHEN 1 THEN 'Должность: [POSITION]' WHEN 2 THEN 'Адрес регистрации: [ADDRESS]' WHEN 3 THEN 'Проживает [ADDRESS]' ELSE 'Жалобы: кашель ' || c_custkey END AS masked FROM customer
""")
def mask_work_and_address(spark, sf_dir):
    k = F.col("k").cast("string")
    x = by_case(F.col("k"), F.concat(F.lit("Место работы: завод "), k), F.lit("Должность: слесарь"), F.concat(F.lit("Адрес регистрации: Сочи, "), k), F.concat(F.lit("проживает в городе Сочи, "), k), F.concat(F.lit("Жалобы: кашель "), k))
    return customers(spark, sf_dir).select("k", masks.addresses(masks.work(x)).alias("masked"))


@query("""
SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN 'Фамилия   [FIO]' WHEN 1 THEN 'Имя [FIO] Возраст: 67' WHEN 2 THEN 'Пациентка [FIO] поступила' WHEN 3 THEN '[FIO]   отделение неврологии' WHEN 4 THEN 'Ф.И.О. [FIO]' ELSE 'Гемоглобин ' || c_custkey END AS masked FROM customer
""")
def fio_table_labels(spark, sf_dir):
    k = F.col("k")
    x = by_case(k, F.lit("Фамилия   Иванов"), F.lit("Имя иванова Возраст: 67"), F.lit("Пациентка Иванова поступила"), F.lit("Ветров   отделение неврологии"), F.lit("Ф.И.О. Смирнова Анна"), F.concat(F.lit("Гемоглобин "), k.cast("string")))
    return customers(spark, sf_dir).select("k", masks.patient_inline(masks.fio_labels(masks.ocr_fio(x))).alias("masked"))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 3 THEN 'Иванов и анализ ' || c_custkey ELSE '[FIO]' END AS masked FROM customer")
def whole_line_fio(spark, sf_dir):
    k = F.col("k")
    x = by_case(k, F.lit("Сидоров Пётр"), F.lit("Владимировна"), F.lit("СИДОРОВ ПЁТР ИВАНОВИЧ"), F.concat(F.lit("Иванов и анализ "), k.cast("string")))
    return customers(spark, sf_dir).select("k", masks.whole_fio(x).alias("masked"))


@query(f"""
SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'пациент, ' || (c_custkey % 60 + 20) || ' лет' WHEN 1 THEN 'осмотр пациента 05.09.2020 / 79 лет' WHEN 2 THEN 'Дата рождения   ' || {PHRASE.format('(75 - c_custkey % 60)')} ELSE 'Дата рождения: ' || {PHRASE.format('(75 - c_custkey % 60)')} END AS masked FROM customer
""")
def dob_with_age(spark, sf_dir):
    k = F.col("k")
    year, age = (2026 - (k % 60 + 20)).cast("string"), (k % 60 + 20).cast("string")
    born = (F.lit(1950) + k % 60).cast("string")
    x = by_case(k, F.concat(F.lit("пациент, 05.09."), year, F.lit(" / "), age, F.lit(" лет")), F.lit("осмотр пациента 05.09.2020 / 79 лет"), F.concat(F.lit("Дата рождения   05.09."), born), F.concat(F.lit("Дата рождения: число 5 месяц сентября год "), born))
    return customers(spark, sf_dir).select("k", masks.birth_fields(masks.dob_with_age(x)).alias("masked"))


@query("SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'принял [FIO]' WHEN 1 THEN '[FIO] осмотрен' WHEN 2 THEN 'Врач [FIO]' ELSE '[FIO] ' || 'и ' || c_custkey END AS masked FROM customer")
def sweep_tails(spark, sf_dir):
    k = F.col("k")
    x = by_case(k, F.lit("принял [FIO] Мария Петровна"), F.lit("ВЕТРОВА [FIO] осмотрен"), F.lit("Врач [FIO]"), F.concat(F.lit("[FIO] [FIO] и "), k.cast("string")))
    return customers(spark, sf_dir).select("k", memory.name_tails(x).alias("masked"))


@query("SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN ['ковалёв'] WHEN 1 THEN [] ELSE ['сергей', 'иванов'] END AS tokens FROM customer")
def path_names(spark, sf_dir):
    x = by_case(F.col("k"), F.lit("архив/Ковалёв/выписка.txt"), F.lit("отчёты/2026/b.docx"), F.lit("Сергей Иванов/1.pdf"))
    return customers(spark, sf_dir).select("k", memory.path_tokens(x).alias("tokens"))
