"""Text normalisation as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from redactrix.functions.subst import let

SPACES = "\u00a0\u202f\u2007\u2009\u200a"
HYPHENS = "\u00ad\u2010\u2011\u2012\u2212"
INVISIBLE = "\u200b\u200c\u200d\ufeff"
#: Where a label and an upper-case value, or an initial and a name, run together.
GLUED = "(?Ud)(?<=[а-яё])(?=[А-ЯЁ]{3,})|(?<=[А-ЯЁ])(?=[А-ЯЁ][а-яё])"


def norm(x: Column) -> Column:
    """Plain spaces and hyphens, no invisible characters, glued labels and values parted."""
    flat = F.translate(x, SPACES + HYPHENS + INVISIBLE, " " * len(SPACES) + "-" * len(HYPHENS))
    return F.regexp_replace(flat, GLUED, " ")


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def norm_line(x: Column) -> Column:
    return F.lower(strip(F.regexp_replace(norm(x), r"(?U)\s+", " ")))


def letters_only(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-zа-яё]+", "")


def digits_count(x: Column) -> Column:
    return F.length(F.regexp_replace(x, r"(?U)\D", ""))


@F.pandas_udf(StringType())
def _nfc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


def unify_controls(x: Column) -> Column:
    """Unicode line breaks as line feeds; control characters other than tab, line feed and return dropped."""
    return F.regexp_replace(F.translate(x, "\u0085\u2028\u2029", "\n\n\n"), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def sanitize(x: Column) -> Column:
    """unify_controls, and composed characters; Python gets null for every text where no combining mark can be."""
    flat = unify_controls(x)
    marked = flat.rlike(r"[\p{M}\u1100-\u11FF\u2126\u212A\u212B\uF900-\uFAFF]")
    return F.coalesce(_nfc(F.when(marked, flat)), flat)


def layout_line(x: Column) -> Column:
    """One line with single spaces, none before closing or after opening punctuation."""
    line = strip(F.regexp_replace(F.translate(x, "\t", " "), "[ \t\u00a0]{2,}", " "))
    line = F.regexp_replace(line, r"(?U)\s+([,;:.!?%)»\]])", "$1")
    line = F.regexp_replace(line, r"(?U)([(«\[])\s+", "$1")
    return F.regexp_replace(line, r"(?U)\s+", " ")


def normalize_layout(x: Column) -> Column:
    """Every line by layout_line; at most one blank line in a row, none at the ends."""
    joined = F.array_join(F.transform(F.split(x, "\n", -1), layout_line), "\n")
    return F.regexp_replace(F.regexp_replace(joined, r"\n{3,}", "\n\n"), r"\A\n+|\n+\z", "")


#: After each of these a line ends; a return before a line feed belongs to it.
LINE_ENDS = "(?<=\n)|(?<=\r)(?!\n)|(?<=[\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029])"


def lines_with_ends(x: Column) -> Column:
    """The lines of a text with their line ends, an empty tail left out."""
    return F.filter(F.split(x, LINE_ENDS, -1), lambda s: s != "")


def feed_lines(x: Column) -> Column:
    """The lines of a text with their line feeds, an empty tail left out; an empty text is one line."""
    return F.filter(F.split(x, "(?<=\n)", -1), lambda s: (s != "") | (x == ""))


def lines(x: Column) -> Column:
    return F.transform(lines_with_ends(x), lambda s: F.regexp_replace(s, r"(?:\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029])\z", ""))


def line_ending(x: Column) -> Column:
    return F.when(x.endswith("\r\n"), "\r\n").when(x.endswith("\n"), "\n").otherwise("")


def wrap(x: Column, width: int) -> Column:
    """Greedy wrapping on spaces to ``width`` characters; longer words are cut. An array of lines."""
    pieces = lambda w: F.when(F.length(w) <= width, F.array(w)).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.length(w) - 1) / width).cast("int")), lambda k: F.substring(w, k * width + 1, F.lit(width))))
    words = F.flatten(F.transform(F.filter(F.split(x, " ", -1), lambda w: w != ""), pieces))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def add(state: Column, word: Column) -> Column:
        longer = F.when(state["line"] == "", word).otherwise(F.concat(state["line"], F.lit(" "), word))
        return F.when(F.length(longer) <= width, F.struct(state["done"].alias("done"), longer.alias("line"))).otherwise(F.struct(F.concat(state["done"], F.array(state["line"])).alias("done"), word.alias("line")))

    return F.aggregate(words, start, add, lambda s: F.concat(s["done"], F.array(s["line"])))


def wrap_lines(x: Column, width: int) -> Column:
    """The lines of a text, each wrapped as by ``wrap``: an array of lines. Whole texts by pattern, without a fold over words."""
    plain = F.regexp_replace(F.regexp_replace(x, " {2,}", " "), "(?<=\n) | (?=\n)|\\A | \\z", "")
    # most words that end at a space or a line's end, else as much of a longer word
    cut = F.regexp_replace(F.concat(plain, F.lit("\n")), f"([^\n]{{0,{width}}})[ \n]|([^\n ]{{{width}}})", "$1$2\n")
    short = F.concat(F.lit("\n"), x, F.lit("\n"))
    as_it_is = ~short.contains("  ") & ~short.contains("\n ") & ~short.contains(" \n") & ~x.rlike(f"[^\n]{{{width + 1}}}")
    return F.when(as_it_is, F.split(x, "\n", -1)).otherwise(let(cut, lambda c: F.split(F.substr(c, F.lit(1), F.length(c) - 1), "\n", -1)))


def bounded(x: Column, longest: int) -> Column:
    return let(x, lambda v: F.substring(v, 1, longest))
