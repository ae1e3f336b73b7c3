"""Reading order of recognised text boxes: two columns where few boxes cross the middle, lines by their anchor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE, CROSSING = 10.0, 0.15
PAGE_BREAK = "\n--- PAGE BREAK ---\n"


def lines(boxes: Column) -> Column:
    """Texts of boxes (y, x, text) line by line. A box joins the line whose first box is nearer than ``LINE``."""
    start = F.struct(F.array().cast("array<array<struct<x:double,text:string>>>").alias("done"), F.array().cast("array<struct<x:double,text:string>>").alias("open"), F.lit(None).cast("double").alias("y"))

    def step(s: Column, b: Column) -> Column:
        here = F.array(F.struct(b["x"].alias("x"), b["text"].alias("text")))
        joins = s["y"].isNull() | (F.abs(b["y"] - s["y"]) < LINE)
        return F.when(joins, F.struct(s["done"].alias("done"), F.concat(s["open"], here).alias("open"), F.coalesce(s["y"], b["y"]).alias("y"))).otherwise(
            F.struct(F.concat(s["done"], F.array(s["open"])).alias("done"), here.alias("open"), b["y"].alias("y"))
        )

    def end(s: Column) -> Column:
        every = F.filter(F.concat(s["done"], F.array(s["open"])), lambda g: F.size(g) > 0)
        return F.array_join(F.transform(every, lambda g: F.array_join(F.transform(F.array_sort(g), lambda b: b["text"]), " ")), "\n")

    return F.aggregate(F.array_sort(boxes), start, step, end)


def page_text(boxes: DataFrame) -> DataFrame:
    """(doc, page, text) of box rows (doc, page, width, x_min, x_max, y_min, text). A page has bounded boxes."""
    crosses = (F.col("x_min") < 0.4 * F.col("width")) & (F.col("x_max") > 0.6 * F.col("width"))
    box = F.struct(F.col("y_min").cast("double").alias("y"), F.col("x_min").cast("double").alias("x"), F.col("text"))
    left = F.col("x_min") < 0.5 * F.col("width")
    pages = boxes.groupBy("doc", "page").agg(F.avg(crosses.cast("double")).alias("crossing"), F.collect_list(box).alias("all"), F.collect_list(F.when(left, box)).alias("l"), F.collect_list(F.when(~left, box)).alias("r"))
    column = lambda c: F.transform(F.array_sort(c), lambda b: b["text"])
    text = F.when((F.col("crossing") < CROSSING) & (F.size("r") > 0), F.array_join(F.concat(column("l"), column("r")), "\n")).otherwise(lines(F.col("all")))
    return pages.select("doc", "page", text.alias("text"))


def document_text(pages: DataFrame) -> DataFrame:
    """(doc, text): pages in order, whatever order they came in."""
    return pages.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), PAGE_BREAK).alias("text"))
