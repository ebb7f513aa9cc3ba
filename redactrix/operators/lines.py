"""Pages as rows of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redactrix.functions.text import feed_lines, line_ending, lines_with_ends, norm, norm_line, strip


def explode_lines(pages: DataFrame, text: str = "text", feeds: bool = False) -> DataFrame:
    """(…, line_no, core, ending, norm, lower) for each line of pages; line numbers begin at 1. No shuffle.

    With ``feeds`` lines end at line feeds only, which are all that core lacks, and an empty text is an empty line.
    """
    rest = [c for c in pages.columns if c != text]
    out = pages.select(*rest, F.posexplode(feed_lines(F.col(text)) if feeds else lines_with_ends(F.col(text))).alias("line_no", "raw"))
    core = F.regexp_replace("raw", r"\n\z" if feeds else r"(?:\r\n|\n)\z", "")
    ending = F.when(F.col("raw").endswith("\n"), "\n").otherwise("") if feeds else line_ending(F.col("raw"))
    return out.select(*[c for c in out.columns if c not in ("line_no", "raw")], (F.col("line_no") + 1).alias("line_no"), core.alias("core"), ending.alias("ending"), strip(norm(core)).alias("norm"), norm_line(core).alias("lower"))


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt by key over as many partitions as shuffles have: small files of rows that cost much use all cores, and
    the windows and groups by these keys that follow need no other exchange."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def blank_pages(pages: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, page_no, text) of the pages without a line, null texts as empty ones."""
    return pages.filter(F.coalesce(F.size(lines_with_ends(F.col(text))), F.lit(0)) <= 0).select("doc_id", "page_no", F.lit("").alias(text))


def page_window(*by: str):
    return Window.partitionBy(*(by or ("doc_id", "page_no"))).orderBy("line_no")


def join_lines(lines: DataFrame, value: str = "core", by=("doc_id",)) -> DataFrame:
    """One text a page from its lines, in order."""
    rows = F.sort_array(F.collect_list(F.struct("line_no", F.concat(F.col(value), F.col("ending")).alias("t"))))
    return lines.groupBy(*by).agg(F.array_join(F.transform(rows, lambda r: r["t"]), "").alias("text"))
