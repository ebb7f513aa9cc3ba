"""Queries over Russian lines made from the tables' keys; their SQL works the answers out by arithmetic and concatenation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactrix.functions import dates, names
from redactrix.functions import patterns as P
from redactrix.operators import automaton, context, masks, memory, reflow
from redactrix.operators.lines import page_window
from redactrix.plans.deidentify import audited, deidentify
from redactrix.plans.real_text import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


SURNAMES, NAMES, FATHERS = ("Иванов", "Петров", "Ковалёв", "Соколов", "Лебедев"), ("Иван", "Пётр", "Сергей", "Николай"), ("Иванович", "Петрович", "Сергеевич")
MONTHS = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")
PHRASE = "(CASE WHEN {0} IS NULL THEN '[AGE]' WHEN {0} % 100 BETWEEN 11 AND 14 OR {0} % 10 = 0 OR {0} % 10 >= 5 THEN {0} || ' лет' WHEN {0} % 10 = 1 THEN {0} || ' год' ELSE {0} || ' года' END)"
AGE = "(2026 - year(o_orderdate) - CASE WHEN month(o_orderdate) * 100 + day(o_orderdate) > 101 THEN 1 ELSE 0 END)"


def customers(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))


def orders(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("cust"), "o_orderdate")


def pick(values, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))


def _sql_pick(values, at: str) -> str:
    return f"(['{"', '".join(values)}'])[({at}) % {len(values)} + 1]"


def by_case(at: Column, *cases) -> Column:
    out = F.lit(None).cast("string")
    for k, value in enumerate(cases):
        out = F.when(at % len(cases) == k, value).otherwise(out)
    return out


def text(k: str, *parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def digits(x: Column, n: int) -> Column:
    return F.lpad(x.cast("string"), n, "0")


@query(f"SELECT o_orderkey AS k, 'Дата рождения: ' || {PHRASE.format(AGE)} AS masked FROM orders")
def age_from_dob(spark, sf_dir):
    return orders(spark, sf_dir).select("k", masks.birth_dates(F.concat(F.lit("Дата рождения: "), F.date_format("o_orderdate", "dd.MM.yyyy"))).alias("masked"))


@query(f"SELECT c_custkey AS k, {PHRASE.format('(c_custkey % 160)')} AS phrase FROM customer")
def age_phrase(spark, sf_dir):
    return customers(spark, sf_dir).select("k", dates.age_phrase(F.col("k") % 160).alias("phrase"))


@query(f"SELECT o_orderkey AS k, {PHRASE.format(AGE)} AS age FROM orders")
def month_word_age(spark, sf_dir):
    day = F.concat(F.lit("родился « "), F.dayofmonth("o_orderdate").cast("string"), F.lit(" » "), pick(MONTHS, F.month("o_orderdate") - 1), F.lit(" "), F.year("o_orderdate").cast("string"), F.lit(" г."))
    return orders(spark, sf_dir).select("k", dates.find_age(dates.plain_days(day)).alias("age"))


@query(f"SELECT c_custkey AS k, 'Пациент, ' || {PHRASE.format('(96 - c_custkey % 90)')} || ', осмотрен' AS masked FROM customer")
def birth_year_age(spark, sf_dir):
    year = (F.lit(1930) + F.col("k") % 90).cast("string")
    return customers(spark, sf_dir).select("k", masks.birth_years(F.concat(F.lit("Пациент, "), by_case(F.col("k"), F.concat(year, F.lit(" г.р.")), F.concat(F.lit("год рождения: "), year)), F.lit(", осмотрен"))).alias("masked"))


def _snils(k: Column) -> tuple[Column, Column]:
    n = digits(F.lit(100_000_000) + k * 7919 % 800_000_000, 9)
    total = sum(F.substring(n, i, 1).cast("int") * (10 - i) for i in range(1, 10))
    return n, (total % 101) % 100


SNILS = "(100000000 + c_custkey * 7919 % 800000000)"


@query(f"SELECT c_custkey AS k, c_custkey % 3 <> 1 AS valid FROM customer WHERE {SNILS} > 1001998")
def snils_checksum(spark, sf_dir):
    n, check = _snils(F.col("k"))
    shown = (check + F.when(F.col("k") % 3 == 1, 1).otherwise(0)) % 100
    return customers(spark, sf_dir).select("k", names.valid_snils(F.concat(F.substring(n, 1, 3), F.lit("-"), F.substring(n, 4, 3), F.lit("-"), F.substring(n, 7, 3), F.lit(" "), digits(shown, 2))).alias("valid"))


@query(f"SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'СНИЛС [SNILS]' ELSE 'Б/Р №' || {SNILS} || '00' END AS masked FROM customer")
def mask_snils_docnum_guard(spark, sf_dir):
    n, _ = _snils(F.col("k"))
    return customers(spark, sf_dir).select("k", masks.global_masks(by_case(F.col("k"), F.concat(F.lit("СНИЛС "), n, F.lit("00")), F.concat(F.lit("Б/Р №"), n, F.lit("00")))).alias("masked"))


@query("""
SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN 'Телефон: [PHONE]' WHEN 1 THEN 'Тел.[PHONE] доб. 12' WHEN 2 THEN '№ направления ' || (1000000000 + c_custkey)
  WHEN 3 THEN 'звонить [PHONE]' ELSE 'ОГРН ' || (89000000000 + c_custkey) END AS masked FROM customer
""")
def mask_phone_contexts(spark, sf_dir):
    k = F.col("k")
    seven = digits(k % 10_000_000, 7)
    nice = F.concat(F.lit("+7 900 "), F.substring(seven, 1, 3), F.lit("-"), F.substring(seven, 4, 2), F.lit("-"), F.substring(seven, 6, 2))
    cases = by_case(k, F.concat(F.lit("Телефон: "), nice), F.concat(F.lit("Тел. "), digits(k + 4_950_000_000, 10), F.lit(" доб. 12")), F.concat(F.lit("№ направления "), (k + 1_000_000_000).cast("string")), F.concat(F.lit("звонить "), F.lit("8 900 "), seven), F.concat(F.lit("ОГРН "), (k + 89_000_000_000).cast("string")))
    return customers(spark, sf_dir).select("k", masks.global_masks(cases).alias("masked"))


@query("""
SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN 'ИНН: [INN]' WHEN 1 THEN 'Полис ОМС № [POLICY]' WHEN 2 THEN 'Листок нетрудоспособности № [SICKLEAVE]'
  WHEN 3 THEN 'Идентификатор: [IDENTIFIER]' WHEN 4 THEN 'Дата выдачи полиса: [DATE]' ELSE 'Количество ' || (c_custkey % 1000) || ' мл' END AS masked FROM customer
""")
def mask_inn_policy_sickleave_identifier(spark, sf_dir):
    k = F.col("k")
    cases = by_case(
        k, F.concat(F.lit("ИНН: "), digits(k + 100_000_000_000, 12)), F.concat(F.lit("Полис ОМС № "), digits(k, 9)), F.concat(F.lit("Листок нетрудоспособности № "), digits(k, 12)),
        F.concat(F.lit("Идентификатор: "), digits(k, 12)), F.concat(F.lit("Дата выдачи полиса: "), F.lit("12.05.2019")), F.concat(F.lit("Количество "), (k % 1000).cast("string"), F.lit(" мл")),
    )
    return customers(spark, sf_dir).select("k", masks.global_masks(cases).alias("masked"))


@query("""
SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'Номер медицинской карты: [MEDICAL_RECORD]' WHEN 1 THEN 'История болезни № [MEDICAL_RECORD]' ELSE 'Медицинская карта пациента, форма 003/у, № [MEDICAL_RECORD]' END AS masked FROM orders
""")
def mask_medical_record(spark, sf_dir):
    n = F.concat((F.col("k") + 1000).cast("string"), F.lit("/2026"))
    return orders(spark, sf_dir).select("k", masks.records(by_case(F.col("k"), F.concat(F.lit("Номер медицинской карты: "), (F.col("k") + 100_000).cast("string")), F.concat(F.lit("История болезни № A-"), n), F.concat(F.lit("Медицинская карта пациента, форма 003/у, № "), n))).alias("masked"))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'Сертификат: [CERTIFICATE]' ELSE 'Сертификат: 0A30' END AS masked FROM customer")
def mask_certificate(spark, sf_dir):
    h = F.upper(F.lpad(F.hex(F.col("k")), 8, "0"))
    long = F.concat(F.lit("Сертификат: 26 0A30 3987 "), F.substring(h, 1, 4), F.lit(" "), F.substring(h, 5, 4), F.lit(" 39A1"))
    return customers(spark, sf_dir).select("k", masks.certificates(by_case(F.col("k"), long, F.lit("Сертификат: 0A30"))).alias("masked"))


def pages(df: DataFrame, value: Column) -> DataFrame:
    return df.select(F.col("k").alias("doc_id"), F.lit(1).alias("page_no"), value.alias("text"))


@query("SELECT c_custkey AS doc_id, 'Адрес:' || chr(10) || '[ADDRESS]' || chr(10) || chr(10) || 'Диагноз: J06.9, запись ' || c_custkey AS text FROM customer")
def mask_address_label_block(spark, sf_dir):
    k = F.col("k").cast("string")
    return automaton.mask_pages(pages(customers(spark, sf_dir), F.concat(F.lit("Адрес:\nг. Москва, ул. Ленина,\nд. "), k, F.lit(", кв. 7\n\nДиагноз: J06.9, запись "), k))).select("doc_id", "text")


@query("SELECT c_custkey AS k, c_custkey % 5 IN (0, 1, 3) AS address FROM customer")
def address_heuristic(spark, sf_dir):
    k = F.col("k").cast("string")
    cases = by_case(F.col("k"), F.concat(F.lit("ул. Водная, д. "), k), F.concat(F.lit("350000, Краснодарский край, село Ивановка "), k), F.concat(F.lit("Состояние улучшилось, д. "), k, F.lit(", г. Сочи")), F.lit("область, город, дом без номера"), F.concat(F.lit("Гемоглобин "), k, F.lit(" г/л")))
    return customers(spark, sf_dir).select("k", names.looks_like_address(cases).alias("address"))


def full_name(k: Column) -> Column:
    return F.concat_ws(" ", pick(SURNAMES, k), pick(NAMES, k), pick(FATHERS, k))


@query("SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'Пациент: [FIO]' WHEN 1 THEN 'Ф.И.О.: [FIO]' ELSE 'Фамилия: [FIO]' END AS masked FROM customer")
def mask_fio_labelled(spark, sf_dir):
    k = F.col("k")
    cases = by_case(k, F.concat(F.lit("Пациент: "), full_name(k)), F.concat(F.lit("Ф.И.О.: "), full_name(k)), F.concat(F.lit("Фамилия: "), pick(SURNAMES, k)))
    return customers(spark, sf_dir).select("k", masks.fio_labels(masks.patient_fio(cases)).alias("masked"))


@query("SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'осмотрен [FIO] на дому' WHEN 1 THEN 'Городская Клиническая Ивановна' ELSE 'консультация [FIO]' END AS masked FROM customer")
def mask_fio_triplet_guard(spark, sf_dir):
    k = F.col("k")
    cases = by_case(k, F.concat(F.lit("осмотрен "), full_name(k), F.lit(" на дому")), F.lit("Городская Клиническая Ивановна"), F.concat(F.lit("консультация "), pick(SURNAMES, k), F.lit(" И.П.")))
    return customers(spark, sf_dir).select("k", masks.inline_fio(cases).alias("masked"))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'Лечащий врач: [FIO]' ELSE 'Владелец: [FIO]' END AS masked FROM customer")
def mask_staff(spark, sf_dir):
    k = F.col("k")
    return customers(spark, sf_dir).select("k", masks.staff(by_case(k, F.concat(F.lit("Лечащий врач: "), pick(SURNAMES, k), F.lit(" П.П.")), F.concat(F.lit("Владелец: "), full_name(k)))).alias("masked"))


@query(f"SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN '[FIO], 45 лет' WHEN 1 THEN '[FIO] ' || {PHRASE.format(AGE)} ELSE '[FIO] осмотрен 12.05.2020' END AS masked FROM orders")
def dob_next_to_fio(spark, sf_dir):
    k, day = F.col("k"), F.date_format("o_orderdate", "dd.MM.yyyy")
    cases = by_case(k, F.concat(F.lit("[FIO], "), day, F.lit(" (45 лет)")), F.concat(F.lit("[FIO] "), day), F.lit("[FIO] осмотрен 12.05.2020"))
    return orders(spark, sf_dir).select("k", masks.birth_date_by_fio(cases, F.lit(False)).alias("masked"))


@query(f"SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN {PHRASE.format(AGE)} || chr(10) || chr(10) || 'Дата рождения' ELSE strftime(o_orderdate, '%d.%m.%Y') || chr(10) || chr(10) || 'Дата приёма' END AS text FROM orders")
def orphan_dob_before_label(spark, sf_dir):
    day = F.date_format("o_orderdate", "dd.MM.yyyy")
    return automaton.mask_pages(pages(orders(spark, sf_dir), F.concat(day, F.lit("\n\n"), by_case(F.col("k"), F.lit("Дата рождения"), F.lit("Дата приёма"))))).select("doc_id", "text")


@query("SELECT o_orderkey AS doc_id, 'Дата выдачи полиса' || chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || '[DATE]' ELSE 'данные обновлены' || chr(10) || strftime(o_orderdate, '%d.%m.%Y') END AS text FROM orders")
def orphan_policy_date(spark, sf_dir):
    day = F.date_format("o_orderdate", "dd.MM.yyyy")
    return automaton.mask_pages(pages(orders(spark, sf_dir), F.concat(F.lit("Дата выдачи полиса\n"), by_case(F.col("k"), F.concat(F.lit("\n"), day), F.concat(F.lit("данные обновлены\n"), day))))).select("doc_id", "text")


#: Kinds of lines by order key: what the windows' SQL knows them by.
LINES = ("", "Лечащий врач:", "01.02.2020", "осмотр проведён", "Паспорт", "Наименование теста   Результат   реф.", "Фамилия", "Подпись")


def order_lines(spark, sf_dir) -> DataFrame:
    """A page for each customer: a line for each order, in order of keys."""
    from pyspark.sql import Window

    core = pick(LINES, F.col("k") * 31 + F.col("cust"))
    rows = orders(spark, sf_dir).select(F.col("cust").alias("doc_id"), "k", F.row_number().over(Window.partitionBy("cust").orderBy("k")).alias("line_no"), core.alias("core"))
    return rows.select("*", F.col("core").alias("norm"), F.lower("core").alias("lower"))


_L = f"WITH l AS (SELECT o_custkey AS doc_id, o_orderkey AS k, (o_orderkey * 31 + o_custkey) % {len(LINES)} AS c FROM orders)"
_W = "OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN"


@query(f"{_L} SELECT doc_id, k, coalesce(last_value(CASE WHEN c IN (0, 2, 7) THEN NULL ELSE c = 1 END IGNORE NULLS) {_W} 6 PRECEDING AND 1 PRECEDING), false) AS doctor FROM l")
def doctor_context_window(spark, sf_dir):
    return order_lines(spark, sf_dir).select("doc_id", "k", context.doctor_above(page_window("doc_id")).alias("doctor"))


@query(f"{_L} SELECT doc_id, k, coalesce(first_value(CASE WHEN c IN (0, 2, 7) THEN NULL ELSE c = 1 END IGNORE NULLS) {_W} 1 FOLLOWING AND 5 FOLLOWING), false) AS doctor FROM l")
def doctor_below_window(spark, sf_dir):
    return order_lines(spark, sf_dir).select("doc_id", "k", context.doctor_below(page_window("doc_id")).alias("doctor"))


@query(f"{_L} SELECT doc_id, k, max(CASE WHEN c = 4 THEN 1 ELSE 0 END) {_W} 1 PRECEDING AND 1 FOLLOWING) = 1 AS passport FROM l")
def passport_context_window(spark, sf_dir):
    return order_lines(spark, sf_dir).select("doc_id", "k", context.passport(page_window("doc_id")).alias("passport"))


@query(f"{_L} SELECT doc_id, k, c NOT IN (6, 4) AND coalesce(last_value(CASE WHEN c IN (6, 4) THEN false WHEN c = 5 THEN true END IGNORE NULLS) {_W} UNBOUNDED PRECEDING AND CURRENT ROW), false) AS study FROM l")
def study_regions(spark, sf_dir):
    return order_lines(spark, sf_dir).select("doc_id", "k", context.study_region(page_window("doc_id")).alias("study"))


@query(f"{_L} SELECT doc_id, k, max(CASE WHEN c IN (1, 7) THEN 1 ELSE 0 END) {_W} 4 PRECEDING AND 4 FOLLOWING) = 1 AS signature FROM l")
def study_signature_window(spark, sf_dir):
    return order_lines(spark, sf_dir).select("doc_id", "k", context.study_signature(page_window("doc_id")).alias("signature"))


@query(f"""{_L}, n AS (SELECT doc_id, k, c, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM l),
e AS (SELECT doc_id, k, i, n, first_value(CASE WHEN c IN (0, 1, 2, 3, 4, 6) THEN i END IGNORE NULLS) {_W} 1 FOLLOWING AND 30 FOLLOWING) AS s FROM n)
SELECT doc_id, k, coalesce(s - 1, least(n, i + 30))::INT AS block_end FROM e""")
def value_block_window(spark, sf_dir):
    return order_lines(spark, sf_dir).select("doc_id", "k", context.value_block_end(page_window("doc_id")).cast("int").alias("block_end"))


@query(f"""{_L}, n AS (SELECT doc_id, k, c, lag(c) OVER (PARTITION BY doc_id ORDER BY k) AS p FROM l) SELECT doc_id, k, c <> 0 AND coalesce(p = 1, false) AS staff FROM n""")
def staff_value_window(spark, sf_dir):
    return order_lines(spark, sf_dir).select("doc_id", "k", context.staff_value(page_window("doc_id")).alias("staff"))


def _two_pages(spark, sf_dir) -> DataFrame:
    k = F.col("k")
    first = F.concat(F.lit("Ф.И.О.: "), full_name(k), F.lit("\nДата рождения: 05.09.1947\nНомер медицинской карты: "), (k + 100_000).cast("string"))
    second = F.concat(F.lit("Осмотр: "), pick(SURNAMES, k), F.lit("у назначено лечение, 05.09.1947, карта передана, "), (k + 100_000).cast("string"), F.lit(" и 2019 году"))
    both = customers(spark, sf_dir).select(k.alias("doc_id"), F.explode(F.array(F.struct(F.lit(1).alias("page_no"), first.alias("text")), F.struct(F.lit(2).alias("page_no"), second.alias("text")))).alias("p"))
    return both.select("doc_id", "p.page_no", "p.text")


_SWEPT = """
SELECT c_custkey AS doc_id, 1 AS page_no, 'Ф.И.О.: [FIO]' || chr(10) || 'Дата рождения: 78 лет' || chr(10) || 'Номер медицинской карты: [MEDICAL_RECORD]' AS text FROM customer
UNION ALL SELECT c_custkey, 2, 'Осмотр: [FIO] назначено лечение, 78 лет, карта передана, [MEDICAL_RECORD] и 2019 году' FROM customer
"""


@query(_SWEPT)
def memory_sweep(spark, sf_dir):
    """Names, birth date and record number said on one page are masked on the other."""
    return deidentify(_two_pages(spark, sf_dir), sweeps=1)


@query(_SWEPT)
def memory_sweep_again(spark, sf_dir):
    """Sweeping once more changes nothing."""
    return deidentify(_two_pages(spark, sf_dir), sweeps=2)


@query("SELECT 0::BIGINT AS found")
def deidentified_audit(spark, sf_dir):
    """Nothing is found in what the whole run gives back."""
    return audited(deidentify(_two_pages(spark, sf_dir))).agg(F.count("*").alias("found"))


@query(f"SELECT c_custkey AS k, {_sql_pick(SURNAMES, 'c_custkey')} AS s, list_sort(list_transform([{_sql_pick(SURNAMES, 'c_custkey')}, {_sql_pick(NAMES, 'c_custkey')}, {_sql_pick(FATHERS, 'c_custkey')}], lambda x: lower(x))) AS tokens FROM customer")
def memory_name_tokens(spark, sf_dir):
    k = F.col("k")
    return customers(spark, sf_dir).select("k", pick(SURNAMES, k).alias("s"), F.array_sort(memory.name_tokens(full_name(k))).alias("tokens"))


@query("""
SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN 'Жалобы на боли в груди' WHEN 1 THEN 'Осмотр проведён.' || chr(10) || 'Назначен анализ ' || c_custkey WHEN 2 THEN 'обследование'
  WHEN 3 THEN 'Рекомендовано:' || ' приём ' || c_custkey || ' мл' ELSE 'первая' || chr(10) || chr(10) || 'вторая' END AS text FROM customer
""")
def reflow_join(spark, sf_dir):
    k = F.col("k").cast("string")
    cases = by_case(F.col("k"), F.lit("Жалобы на боли в\nгруди"), F.concat(F.lit("Осмотр проведён.\nНазначен анализ "), k), F.lit("обследо-\nвание"), F.concat(F.lit("Рекомендовано:\nприём "), k, F.lit(" мл")), F.lit("первая\n\nвторая"))
    return customers(spark, sf_dir).select("k", reflow.reflow(cases).alias("text"))


@query("SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS doctor FROM customer")
def doctor_line(spark, sf_dir):
    cases = by_case(F.col("k"), F.lit("Лечащий врач Сидоров"), F.lit("Пациент: направлен к хирургу"), F.lit("консультация хирурга"), F.lit("отделение неврологии, хирург"))
    return customers(spark, sf_dir).select("k", names.is_doctor_line(cases).alias("doctor"))


@query("SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS span FROM customer")
def label_span(spark, sf_dir):
    from pyspark.sql import Window

    parts = F.split(by_case(F.col("k"), F.lit("регистрация|по месту|жительства"), F.lit("место|жительства"), F.lit("адрес"), F.lit("вес|100")), r"\|")
    rows = customers(spark, sf_dir).select("k", F.posexplode(parts).alias("line_no", "core")).withColumn("norm", F.col("core"))
    # no line of a label over two or three lines is a label by itself
    exact = P.I + r"^(?:регистрация по месту жительства|место жительства|адрес)$"
    span = context.label_span(exact, Window.partitionBy("k").orderBy("line_no"))
    return rows.withColumn("span", span).filter("line_no = 0").select("k", F.col("span").cast("int").alias("span"))
