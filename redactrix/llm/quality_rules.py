"""Quality rules: a table of thresholds compiled into one projection, without user functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactrix.llm.common import SPACE_CLASS, fresh

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20

#: Frequent words of the four languages, for the share of stop words.
STOP_WORDS = (
    "a and are as at be by for from he in is it not of on or that the this to was with you "
    "au avec dans de des du elle en est et il la le les ne pas pour qui que sur un une "
    "auf das dem den der die ein eine er es ist mit nicht sich sie und von zu "
    "al como con del el ella las lo los no para por se su una y"
).split()

#: name, numerator, denominator, smallest and largest ratio of a kept document, least denominator for the rule to apply.
RULES = (
    ("word_length", "word_chars", "n_words", 2.0, 15.0, 1),
    ("symbols", "n_symbols", "n_words", None, 0.1, 1),
    ("marks", "n_marks", "n_words", None, 0.5, 1),
    ("stop_words", "n_stop_words", "n_words", 0.02, None, 50),
    ("dup_lines", "n_dup_lines", "n_lines", None, 0.5, 4),
    ("bullets", "n_bullet_lines", "n_lines", None, 0.9, 4),
    ("ellipses", "n_ellipsis_lines", "n_lines", None, 0.3, 4),
)


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS))


def n_chars_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _repeated(w: Column) -> Column:
    """Words inside windows that occur at least twice; windows are compared as strings where their hashes repeat."""
    span = F.sequence(F.lit(0), F.size(w) - WINDOW)
    window = lambda i: [F.get(w, i + k) for k in range(WINDOW)]
    hashes = F.transform(span, lambda i: F.xxhash64(*window(i)))
    keyed = F.sort_array(F.transform(span, lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("k"), i.alias("p"))))
    same = lambda s, x, j: F.coalesce(F.get(s, j)["k"] == x["k"], F.lit(False))
    places = lambda s: F.sort_array(F.transform(F.filter(s, lambda x, j: same(s, x, j - 1) | same(s, x, j + 1)), lambda x: x["p"]))
    covered = lambda ps: F.aggregate(F.transform(ps, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(ps, j + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)
    exact = let(keyed, lambda s: let(places(s), covered))
    some = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.size(w) < WINDOW, F.lit(0).cast("long")).when(some, exact).otherwise(F.lit(0).cast("long"))


def _count(a: Column, test) -> Column:
    return F.size(F.filter(a, test)).cast("long")


def measures(text: Column) -> Column:
    """All counts of one text as a struct."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    word_part = let(words(t), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), _repeated(w).alias("n_repeat_words"),
        _count(w, lambda x: F.lower(x).isin(STOP_WORDS)).alias("n_stop_words"),
    ))
    line_part = let(lines, lambda a: F.struct(
        F.size(a).cast("long").alias("n_lines"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
        _count(a, lambda x: F.substring(F.btrim(x, F.lit(SPACES)), 1, 1).isin("-", "*", "•")).alias("n_bullet_lines"),
        _count(a, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…")).alias("n_ellipsis_lines"),
    ))
    return F.struct(
        word_part.alias("w"), line_part.alias("l"), F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        n_chars_of(t, SYMBOLS).alias("n_symbols"), n_chars_of(t, "!?").alias("n_marks"),
    )


COUNTS = {"n_words": "w.n_words", "word_chars": "word_chars", "n_symbols": "n_symbols", "n_marks": "n_marks", "n_stop_words": "w.n_stop_words", "n_repeat_words": "w.n_repeat_words", "n_lines": "l.n_lines", "n_dup_lines": "l.n_dup_lines", "n_bullet_lines": "l.n_bullet_lines", "n_ellipsis_lines": "l.n_ellipsis_lines"}


def compile_rules(count, rules=RULES) -> Column:
    """True where some rule of the table fails; ``count`` gives the column of a count. Ratios are compared as products."""
    failed = []
    for _, top, under, low, high, least in rules:
        a, b = count(top).cast("double"), count(under).cast("double")
        if low is not None:
            failed.append((b >= least) & (a < b * low))
        if high is not None:
            failed.append((b >= least) & (a > b * high))
    return reduce(lambda x, y: x | y, failed)


def judge(docs: DataFrame, rules=RULES, prefix: str = "") -> DataFrame:
    """docs with the counts, base_failed and kept added (names begin with ``prefix``).

    One projection, no shuffle. Null or empty text: no words, so base_failed. Counts are of the whole text;
    repeated rows are judged alike. Columns of docs with the names of counts are replaced: give a prefix.
    """
    (m,) = fresh(docs, "measured")
    out = docs.withColumn(m, measures(F.col("text")))
    count = lambda c: F.col(f"{m}.{COUNTS[c]}")
    base = (count("n_words") < MIN_WORDS) | (100 * count("n_repeat_words") > MAX_REPEAT_PERCENT * count("n_words"))
    keep = [c for c in docs.columns if c not in {prefix + x for x in (*COUNTS, "base_failed", "kept")}]
    return out.select(*keep, *[count(c).alias(prefix + c) for c in COUNTS], base.alias(prefix + "base_failed"), (~base & ~compile_rules(count, rules)).alias(prefix + "kept"))


def keep_good(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of docs that the rules keep, with their own columns only."""
    (prefix,) = fresh(docs, "quality_")
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return judge(docs, rules, prefix).filter(F.col(prefix + "kept")).select(*docs.columns)
