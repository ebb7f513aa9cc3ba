"""Is it a name, an address, a number of a kind: predicates as boolean columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from redactrix.functions import patterns as P
from redactrix.functions.subst import let
from redactrix.functions.text import digits_count, norm, strip

EDGES = ".,;:\"'«»()[]"
_begins = lambda stems: "(?Udi)^(?:" + "|".join(stems) + ")"


def has_org_word(x: Column) -> Column:
    return F.exists(F.split(x, r"(?U)[\s\-]+"), lambda w: F.btrim(w, F.lit(EDGES)).rlike(_begins(P.ORG_GEO_STEMS)))


def has_clinical_word(x: Column) -> Column:
    return F.exists(F.transform(F.split(x, r"(?U)[\s\-/.,]+"), lambda w: F.lower(F.btrim(w, F.lit(EDGES + "/")))), lambda w: w.isin(P.CLINICAL_WORDS) | w.rlike(_begins(P.CLINICAL_STEMS)))


def is_not_fio(x: Column) -> Column:
    return let(F.regexp_replace(x, P.INITIAL_TOKEN, " "), lambda p: has_org_word(p) | has_clinical_word(p))


def is_namelike(t: Column) -> Column:
    return (F.length(t) >= 3) & t.rlike("^[А-ЯЁ][А-Яа-яёЁ]+$") & ~F.lower(t).isin(P.NOT_NAMES) & ~is_not_fio(t)


def is_strong_name(t: Column) -> Column:
    known = F.lower(t).isin([n.lower() for n in P.FIRST_NAMES])
    return is_namelike(t) & (known | F.lower(t).rlike("(?Udi)" + P.SURNAME_END + "$") | F.lower(t).rlike(P.PATRONYMIC_END))


def is_sweepable(token: Column, labelled: Column) -> Column:
    """May a remembered token (lower case) be masked wherever it stands?"""
    return is_strong_name(F.initcap(token)) | (~token.rlike(P.NON_NAME_END) & labelled)


def is_doctor_line(x: Column) -> Column:
    probe = F.regexp_replace(x, r"(?U)\S*\d\S*", " ")
    return probe.rlike(P.DOCTOR_CONTEXT) & (probe.rlike(P.DOCTOR_ROLE) | (~x.rlike(P.PATIENT_MARKER) & ~probe.rlike(P.DEPARTMENT)))


def is_card_number_line(x: Column) -> Column:
    return ~x.rlike(P.NOT_CARD_NUMBER) & x.rlike(P.LEADING_RECORD) & (digits_count(F.regexp_extract(x, P.LEADING_RECORD, 2)) >= 3)


def _markers(x: Column, pattern: str) -> Column:
    return F.size(F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), lambda m: F.substring(F.rtrim(strip(F.lower(m)), F.lit(".")), 1, 4))))


def looks_like_address(x: Column) -> Column:
    """A street and a number, a postal index and a marker, a number and two markers, or three markers; never "улучшение"."""

    def count(s: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(s, P.BIRTH_YEAR_BEFORE, " "), P.BIRTH_YEAR_AFTER, " ")
        return let(bare, lambda b: F.struct(_markers(b, P.ADDRESS_STRONG).alias("strong"), _markers(b, P.ADDRESS_WEAK).alias("weak"), b.rlike(P.POSTAL_INDEX).alias("index"), s.rlike(r"(?U)\d").alias("digit")))

    enough = lambda m: ((m["strong"] > 0) & m["digit"]) | (m["index"] & (m["strong"] + m["weak"] > 0)) | (m["digit"] & (m["strong"] + m["weak"] >= 2)) | (m["strong"] + m["weak"] >= 3)
    some = lambda s: s.rlike(P.ADDRESS_STRONG) | s.rlike(P.ADDRESS_WEAK)
    return let(strip(norm(x)), lambda s: F.when(some(s) & ~F.lower(s).contains("улучш"), let(count(s), enough)).otherwise(False))


def valid_snils(x: Column) -> Column:
    """Eleven digits whose last two are the check number of the first nine."""
    d = F.regexp_replace(x, r"(?U)\D", "")
    total = sum(F.substring(d, k, 1).cast("int") * (10 - k) for k in range(1, 10))
    check = (total % 101) % 100
    good = (F.substring(d, 1, 9).cast("long") > 1001998) & (check == F.substring(d, 10, 2).cast("int"))
    return F.when(F.length(d) == 11, good).otherwise(False)
