"""Masks of one line, in the order that matters, as column expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactrix.functions import dates
from redactrix.functions import patterns as P
from redactrix.functions.names import has_org_word, is_card_number_line, is_not_fio, is_strong_name, looks_like_address
from redactrix.functions.subst import let, sub_each
from redactrix.functions.text import digits_count, norm_line, strip

rr = F.regexp_replace
#: What a line must hold for a family of rules to be tried at all; for a phone.
CYRILLIC, DIGIT, MAIL, TEN_DIGITS = r"[А-Яа-яЁё]", r"(?U)\d", "@", r"(?U)\d(?:[\s\-()]*\d){9}"


def mask_email(x: Column) -> Column:
    return rr(x, P.EMAIL, "[EMAIL]")


def mask_intl_phone(x: Column) -> Column:
    return rr(x, P.INTL_PHONE, "[PHONE]")


def mask_passport(x: Column) -> Column:
    return rr(x, P.PASSPORT, "[PASSPORT]")


def identifiers(x: Column) -> Column:
    """Phones with a country code, e-mails, labelled numbers, policy dates; social numbers unless the line is about a document's number."""
    plus = x.contains("+")
    if_plus = F.when(plus, rr(rr(x, P.INTL_PHONE, "[PHONE]"), P.OCR_PHONE, "[PHONE]")).otherwise(x)
    mail = lambda t: F.when(t.contains("@"), rr(t, P.EMAIL, "[EMAIL]")).otherwise(t)

    def numbers(t: Column) -> Column:
        t = rr(rr(t, P.INN, "$1[INN]"), P.IDENTIFIER, "$1[IDENTIFIER]")
        t = rr(rr(rr(t, P.POLICY, "$1[POLICY]"), P.POLICY_NUMBER, "$1[POLICY]"), P.POLICY_DATE, "$1[DATE]")
        t = rr(t, P.SICK_LEAVE, "$1[SICKLEAVE]")
        return let(t, lambda v: F.when(v.rlike(P.DOC_NUMBER), v).otherwise(rr(v, P.SNILS, "[SNILS]")))

    # without a digit only an e-mail or a policy's date in words can be there
    return F.when(x.rlike(DIGIT), let(let(if_plus, mail), numbers)).otherwise(rr(mail(x), P.POLICY_DATE, "$1[DATE]"))


def phones(x: Column, after_card_label: Column | None = None) -> Column:
    """Any ten digits where a phone is named; strict forms elsewhere, but not beside card and document numbers."""

    def by_context(low: Column) -> Column:
        card = low.rlike(P.CARD_CONTEXT) | low.rlike(P.CARD_LABEL_INLINE) | low.rlike(P.DOC_NUMBER) | is_card_number_line(low)
        if after_card_label is not None:
            card = card | after_card_label
        return F.when(low.rlike(P.PHONE_LABEL), rr(x, P.PHONE, "[PHONE]")).when(card, x).otherwise(rr(x, P.STRICT_PHONE, "[PHONE]"))

    return F.when(x.rlike(TEN_DIGITS), let(norm_line(x), by_context)).otherwise(x)


def labelled_snils(x: Column) -> Column:
    """Social numbers after their label, whatever their first digits: before phones, which may begin with 7, 8 or 9, too."""
    return F.when(x.rlike(P.SNILS_LABELLED) & ~x.rlike(P.DOC_NUMBER), rr(x, P.SNILS_LABELLED, "$1[SNILS]")).otherwise(x)


def global_masks(x: Column, after_card_label: Column | None = None) -> Column:
    """Labelled social numbers, phones, then identifiers; a line with an organisation's number is left as it is."""
    masked = lambda t: let(let(labelled_snils(t), lambda v: phones(v, after_card_label)), identifiers)
    return let(x, lambda t: F.when(norm_line(t).rlike(P.ORG_ID), t).otherwise(masked(t)))


def mask_enp(x: Column) -> Column:
    """Sixteen digits as a policy, unless the line is about a card or history."""
    low = F.lower(x)
    return F.when(low.rlike(P.CARD_CONTEXT) | low.contains("карт") | low.contains("истори"), x).otherwise(rr(x, P.ENP, "[POLICY]"))


def birth_years(x: Column, as_of: dt.date = dates.AS_OF) -> Column:
    year = lambda m: dates.year_age(F.regexp_extract(m, r"(?:19|20)\d{2}", 0), as_of)
    return sub_each(sub_each(x, P.BIRTH_YEAR_BEFORE, year), P.BIRTH_YEAR_AFTER, year)


def records(x: Column) -> Column:
    """Numbers of medical records after their labels."""
    return rr(rr(x, P.RECORD_HEADER, "$1[MEDICAL_RECORD]"), P.RECORD_INLINE, "$1$2[MEDICAL_RECORD]")


def leading_record(x: Column, under_header: Column | None = None) -> Column:
    """A number that begins the line: of three digits or more, or any under the header of a medical card."""
    sure = is_card_number_line(x)
    return F.when(sure if under_header is None else sure | under_header, rr(x, P.LEADING_RECORD, "$1[MEDICAL_RECORD]$3")).otherwise(x)


def certificates(x: Column) -> Column:
    value = F.regexp_extract(x, P.CERTIFICATE, 2)
    long_enough = F.length(rr(value, r"(?U)[^\p{L}\p{N}]", "")) >= 16
    return F.when(x.rlike(P.CERTIFICATE) & long_enough, rr(x, P.CERTIFICATE, "$1[CERTIFICATE]")).otherwise(x)


def passports(x: Column, context: Column) -> Column:
    x = rr(rr(x, P.PASSPORT_SERIES, "$1[PASSPORT]"), P.PASSPORT, "[PASSPORT]")
    return F.when(context, rr(x, P.PASSPORT_IN_CONTEXT, "$1[PASSPORT]")).otherwise(x)


def birth_dates(x: Column, as_of: dt.date = dates.AS_OF) -> Column:
    """Dates after a date-of-birth label as ages; sex, age and date in one field as sex and age."""
    x = sub_each(x, P.SEX_AGE_DOB, lambda m, head, age: F.concat(head, dates.age_phrase(age)), 2)
    return sub_each(x, P.DOB_DATE_INLINE, lambda m, head, day: F.concat(head, F.coalesce(dates.find_age(day, as_of), F.lit(dates.UNKNOWN))), 2)


def birth_date_by_fio(x: Column, force: Column, as_of: dt.date = dates.AS_OF) -> Column:
    """The date right after a masked name: the age stated beside it, else (for a patient or a likely birth year) the age it gives."""

    def decide(m: Column, head: Column, age: Column) -> Column:
        year = F.regexp_extract(m, r"\d{4}", 0).try_cast("int")
        likely = F.coalesce(year.between(1900, as_of.year - 14), F.lit(False))
        return F.when(age != "", F.concat(head, F.btrim(strip(age), F.lit("(),; ")))).when(~force & ~likely, m).otherwise(F.concat(head, F.coalesce(dates.find_age(m, as_of), F.lit(dates.UNKNOWN))))

    return sub_each(x, P.FIO_DOB, decide, 2)


def fio_labels(x: Column) -> Column:
    """The whole value of the first name field that the line is."""
    out = x
    for pattern in reversed((P.FIO_INLINE_LABEL, P.FIO_NO_COLON, *P.NAME_PART_LABELS, *P.NAME_PART_TABLES)):
        out = F.when(x.rlike(pattern), rr(x, pattern, "$1[FIO]")).otherwise(out)
    return out


def ocr_fio(x: Column) -> Column:
    """Names in a field whose colon or capitals were lost in recognition, up to the next field."""
    return rr(x, P.OCR_FIO_LABEL, "$1[FIO]")


def whole_fio(x: Column) -> Column:
    """A line that is a name and nothing else; in capitals only if it is no organisation or study."""
    names = x.rlike(P.FIO_LINES[0]) | x.rlike(P.FIO_LINES[1]) | x.rlike(P.FIO_LINES[2]) | x.rlike(P.PATRONYMIC_LINE)
    capitals = (x.rlike(P.FIO_LINES[3]) | x.rlike(P.FIO_LINES[4])) & ~is_not_fio(x)
    return F.when(~x.rlike(P.CLINICAL_LINE) & (names | capitals), "[FIO]").otherwise(x)


def patient_fio(x: Column) -> Column:
    """Names after a patient's role: two words or more, or one that is surely a name."""

    def decide(m: Column, head: Column, name: Column) -> Column:
        words = F.split(strip(name), r"(?U)\s+")
        sure = (F.size(words) >= 2) | F.exists(words, is_strong_name)
        return F.when(~is_not_fio(name) & sure, F.concat(head, F.lit("[FIO]"))).otherwise(m)

    return sub_each(x, P.PATIENT_LABEL_FIO, decide, 2)


def inline_fio(x: Column) -> Column:
    """Full names and names with initials anywhere, then names by a known first name; not organisations or studies."""
    guarded = lambda m: F.when(is_not_fio(m), m).otherwise("[FIO]")
    for pattern in (P.FIO_TRIPLET, P.FIO_WITH_INITIALS, P.FIO_UPPER_TRIPLET, P.FIO_UPPER_INITIALS, P.FIO_INITIALS_UPPER):
        x = sub_each(x, pattern, guarded)
    for pattern in P.DICTIONARY_FIO:
        x = sub_each(x, pattern, lambda m: F.when(has_org_word(m), m).otherwise("[FIO]"))
    return x


def patient_inline(x: Column) -> Column:
    """A surname alone before a column that is kept, then names after a patient's role in a sentence."""

    def decide(m: Column, head: Column, name: Column) -> Column:
        words = F.split(strip(name), r"(?U)\s+")
        return F.when(~is_not_fio(name) & ((F.size(words) >= 2) | F.exists(words, is_strong_name)), F.concat(head, F.lit(" [FIO]"))).otherwise(m)

    return sub_each(rr(x, P.STRAY_SURNAME, "$1[FIO]"), P.PATIENT_INLINE, decide, 2)


def birth_fields(x: Column, as_of: dt.date = dates.AS_OF) -> Column:
    """Lines of a birth date or an age without a colon, in a table, in words, or behind other text: the age they give."""
    age = lambda rest: F.coalesce(dates.find_age(rest, as_of), F.lit(dates.UNKNOWN))
    split = lambda m, head, d, month, y: F.concat(head, age(F.concat_ws(" ", d, month, y)))
    x = sub_each(x, P.DOB_AGE_ROW, lambda m, head, day, said: F.concat(head, said), 3)
    x = sub_each(x, P.DOB_SPLIT, split, 4)

    def rest_of(t: Column, pattern: str, when: Column, between: str = "") -> Column:
        return F.when(t.rlike(pattern) & when, F.concat(F.regexp_extract(t, pattern, 1), F.lit(between), age(F.regexp_extract(t, pattern, 2)))).otherwise(t)

    x = let(x, lambda t: rest_of(t, P.DOB_TABLE, F.lit(True)))
    x = let(x, lambda t: rest_of(t, P.DOB_LABEL_REST, ~F.regexp_extract(t, P.DOB_LABEL_REST, 2).rlike(P.FIELD_INSIDE)))
    x = let(x, lambda t: rest_of(t, P.DOB_LINE, F.regexp_extract(t, P.DOB_LINE, 2).rlike(P.ANY_RAW_DATE), " "))
    return let(x, lambda t: rest_of(t, P.AGE_INLINE, F.lit(True)))


def dob_with_age(x: Column, as_of: dt.date = dates.AS_OF) -> Column:
    """A date beside a stated age that fits it within a year, on a line about a person: the age alone."""

    def decide(m: Column, said: Column) -> Column:
        gap = F.abs(F.lit(as_of.year) - F.year(dates.birth_day(m, as_of)) - F.regexp_extract(said, r"\d{1,3}", 0).cast("int"))
        return F.when(F.coalesce(gap <= 1, F.lit(False)), said).otherwise(m)

    return let(x, lambda t: F.when(t.rlike(P.AGE_CONTEXT), sub_each(t, P.DOB_WITH_AGE, decide, 1)).otherwise(t))


def staff(x: Column) -> Column:
    return rr(x, P.STAFF_LABEL_VALUE, "$1[FIO]")


def work(x: Column) -> Column:
    return F.when(x.rlike(P.WORKPLACE), rr(x, P.WORKPLACE, "$1[WORKPLACE]")).otherwise(rr(x, P.POSITION, "$1[POSITION]"))


def addresses(x: Column) -> Column:
    x = F.when(x.rlike(P.ADDRESS_INLINE), rr(x, P.ADDRESS_INLINE, "$1[ADDRESS]")).otherwise(rr(x, P.ADDRESS_MIDLINE, "$1[ADDRESS]"))
    return rr(x, P.LIVES_IN, "Проживает [ADDRESS]")


def heuristic_address(x: Column) -> Column:
    """A whole line that looks like an address, its indentation kept."""
    return F.when(looks_like_address(x) & ~x.contains("[ADDRESS]"), F.concat(F.regexp_extract(x, r"(?U)^\s*", 0), F.lit("[ADDRESS]"))).otherwise(x)


def line_rules() -> tuple:
    """name, gate (what the line must hold), guard over its flags (None: always), mask. The order is part of the meaning."""
    plain = ~F.col("doctor") & ~F.col("study")
    return (
        ("patient_fio", CYRILLIC, None, patient_fio),
        ("ocr_fio", CYRILLIC, None, ocr_fio),
        ("whole_fio", CYRILLIC, plain, whole_fio),
        ("fio_labels", CYRILLIC, None, fio_labels),
        ("inline_fio", CYRILLIC, plain, inline_fio),
        ("patient_inline", CYRILLIC, plain, patient_inline),
        ("passport", DIGIT, F.col("passport"), lambda x: passports(x, F.lit(True))),
        ("birth_dates", DIGIT, None, birth_dates),
        ("birth_fields", DIGIT, None, birth_fields),
        ("by_fio", DIGIT, ~F.col("study_signature"), lambda x: birth_date_by_fio(x, x.rlike(P.PATIENT_MARKER))),
        ("work", CYRILLIC, None, work),
        ("addresses", CYRILLIC, None, addresses),
        ("address_line", CYRILLIC, ~F.col("study"), heuristic_address),
        ("records", DIGIT, None, lambda x: leading_record(records(x), F.col("card_header"))),
        ("global", DIGIT + "|" + MAIL + "|" + CYRILLIC, None, lambda x: global_masks(x, F.col("after_card_label"))),
        ("enp", DIGIT, None, mask_enp),
        ("birth_years", DIGIT, None, birth_years),
        ("staff", CYRILLIC, None, staff),
        ("certificates", DIGIT, None, certificates),
    )


def apply_line_rules(lines: DataFrame, column: str) -> DataFrame:
    """All line rules on a column, in order, a projection for each; rows hold the flags doctor, study, passport, study_signature, after_card_label and card_header."""
    # no rule brings digits or letters to a line that had neither, so gates are worked out once
    gates = {gate: f"gate {k}" for k, gate in enumerate(sorted({r[1] for r in line_rules()}))}
    lines = lines.withColumns({name: F.col(column).rlike(gate) for gate, name in gates.items()})
    for _, gate, guard, mask in line_rules():
        open_ = F.col(gates[gate])
        lines = lines.withColumn(column, F.when(open_ if guard is None else open_ & guard, mask(F.col(column))).otherwise(F.col(column)))
    return lines.drop(*gates.values())
