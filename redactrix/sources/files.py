"""Folders of documents: discovery, snapshots that are checked again, names of outputs."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redactrix.functions import patterns as P

SUPPORTED = (*P.TEXT_FORMATS, ".pdf", *P.IMAGE_FORMATS)
NO_EXTENSION = "без расширения"
SCHEMA = "rel_path string, name string, ext string, size long"


def visible(rel_path: Column) -> Column:
    """No part of the path is hidden, and the name is none of an office program's lock files."""
    parts = F.split(rel_path, "/")
    return ~F.exists(parts, lambda p: p.startswith(".")) & ~F.element_at(parts, -1).startswith("~$")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^.](\.[^./]+)$", 1))


def walk(spark: SparkSession, folder: str) -> DataFrame:
    """All regular files below a folder (links are not followed), listed on the driver: names only."""
    root, rows = Path(folder).resolve(), []
    for at, _, names in os.walk(root):
        for name in names:
            p = Path(at, name)
            if p.is_file() and not p.is_symlink():
                rows.append((p.relative_to(root).as_posix(), name, p.stat().st_size))
    return spark.createDataFrame(rows, "rel_path string, name string, size long").withColumn("ext", extension(F.col("name"))).select("rel_path", "name", "ext", "size")


def numbered(files: DataFrame) -> DataFrame:
    """Files in order of their paths without case, numbered from 1. One window over a folder's names."""
    return files.withColumn("number", F.row_number().over(Window.orderBy(F.lower("rel_path"), "rel_path")))


def discover(listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files that can be read, numbered; counts of the others by extension)."""
    seen = listed.filter(visible(F.col("rel_path")))
    known = F.col("ext").isin(*SUPPORTED)
    skipped = seen.filter(~known).groupBy(F.when(F.col("ext") == "", NO_EXTENSION).otherwise(F.col("ext")).alias("ext")).agg(F.count("*").alias("n"))
    return numbered(seen.filter(known)), skipped


def manifest(listed: DataFrame) -> DataFrame:
    """A snapshot (position, rel_path) held against the rules again: inside the folder, visible, readable, the first of equal paths."""
    plain = F.regexp_replace("rel_path", r"^(?:\./)+", "")
    ok = listed.withColumn("rel_path", plain).withColumn("ext", extension(F.col("rel_path")))
    ok = ok.filter(~F.col("rel_path").startswith("/") & ~F.array_contains(F.split("rel_path", "/"), "..") & visible(F.col("rel_path")) & F.col("ext").isin(*SUPPORTED))
    first = Window.partitionBy("rel_path").orderBy("position")
    return ok.withColumn("rn", F.row_number().over(first)).filter("rn = 1").select("position", "rel_path", "ext")


def kind(ext: Column) -> Column:
    """What a file looks like in a list."""
    return F.when(ext == ".pdf", "pdf").when(ext.isin(*P.IMAGE_FORMATS), "image").when(ext.isin(".docx", ".rtf", ".odt", ".odg"), "doc").when(ext.isin(".xlsx", ".xlsm"), "sheet").otherwise("text")


def output_folder(source: str, stamp: str, name: str = "Обезличенные") -> str:
    """A folder beside the source that is not there yet: the name, then with the time, then numbered."""
    parent = Path(source).resolve().parent
    tries = [name, f"{name}_{stamp}"]
    k = 1
    while True:
        for t in tries:
            if not (parent / t).exists():
                return str(parent / t)
        k += 1
        tries = [f"{name}_{stamp}_{k}"]


def image_coverage(images: DataFrame) -> DataFrame:
    """(doc_id, page_no, coverage) from rects (doc_id, page_no, xref, w, h, page_w, page_h): each image once, at most the page."""
    once = images.dropDuplicates(["doc_id", "page_no", "xref"])
    area = F.sum(F.col("w") * F.col("h")) / F.greatest(F.lit(1.0), F.max(F.col("page_w") * F.col("page_h")))
    return once.groupBy("doc_id", "page_no").agg(F.least(F.lit(1.0), area).alias("coverage"))


def needs_ocr(text: Column, has_images: Column, coverage: Column) -> Column:
    n = F.length(F.btrim(text))
    return F.when(n == 0, has_images).otherwise(has_images & (n < 500) & (coverage >= 0.35))


def reading_order(boxes: DataFrame) -> DataFrame:
    """(doc_id, page_no, text): recognised fragments (text, left, top, height, center) in rows from top to bottom.

    Fragments go down the page; one joins the row before if its centre is near that row's mean centre.
    """
    order = F.sort_array(F.collect_list(F.struct("top", "left", "height", "center", "text")))
    one = lambda f: F.struct(f["left"].alias("left"), f["text"].alias("text"))
    row = lambda f: F.struct(F.array(one(f)).alias("items"), f["center"].alias("sum"), f["height"].alias("tallest"), F.lit(1).alias("n"))
    kinds = "array<struct<items:array<struct<left:double,text:string>>,sum:double,tallest:double,n:int>>"

    def add(rows: Column, f: Column) -> Column:
        last = F.element_at(rows, -1)
        near = F.abs(f["center"] - last["sum"] / last["n"]) <= F.greatest(F.lit(8.0), 0.6 * F.least(f["height"], last["tallest"]))
        grown = F.struct(F.concat(last["items"], F.array(one(f))).alias("items"), (last["sum"] + f["center"]).alias("sum"), F.greatest(last["tallest"], f["height"]).alias("tallest"), (last["n"] + 1).alias("n"))
        return F.when((F.size(rows) > 0) & near, F.concat(F.slice(rows, F.lit(1), F.size(rows) - 1), F.array(grown))).otherwise(F.concat(rows, F.array(row(f)))).cast(kinds)

    safe = lambda rows, f: F.when(F.size(rows) == 0, F.array(row(f)).cast(kinds)).otherwise(add(rows, f))
    folded = F.aggregate("boxes", F.array().cast(kinds), safe)
    text = F.array_join(F.transform(folded, lambda r: F.array_join(F.transform(F.sort_array(r["items"]), lambda i: i["text"]), "  ")), "\n")
    return boxes.groupBy("doc_id", "page_no").agg(order.alias("boxes")).select("doc_id", "page_no", text.alias("text"))


def millimetres(length: Column) -> Column:
    """A drawing's length as millimetres; an unknown unit counts as millimetres, no number as 0."""
    number = F.regexp_extract(length, r"^\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(length, r"([A-Za-z]+)\s*$", 1))
    factor = F.when(unit == "cm", 10.0).when(unit == "in", 25.4).when(unit == "pt", 25.4 / 72).when(unit == "pc", 25.4 / 6).when(unit == "px", 25.4 / 96).otherwise(1.0)
    return F.coalesce(number * factor, F.lit(0.0))
