"""Web pages as spans of text with places, and their lists and tables as regions: a scan of tags by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

#: A tag and the text behind it. Tags that go on in the same line; those that open and close a region.
TAG = r"<(/?[a-zA-Z0-9!]+)[^>]*>([^<]*)"
INLINE = ("a", "/a", "b", "/b", "i", "/i", "em", "/em", "strong", "/strong", "span", "/span")
REGIONS = ("ul", "ol", "table")
#: Sizes of text and of headings h1 to h6; width of a character and heights of lines.
SIZE, HEADS = 11.0, {f"h{k}": 22.0 - 2 * k for k in range(1, 7)}
WIDTH, STEP, HEIGHT = 6.0, 12.0, 10.0


def tags(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(document_id, seq, tag, text, block, line, region): each tag with the text behind it. Heads, scripts and styles are left out. A tag that isn't inline
    begins a line and, unless it is a line break, a block; region numbers the lists and tables of a page, null outside."""
    html = F.col(html_col)
    for name in ("head", "script", "style"):
        html = F.regexp_replace(html, rf"(?is)<{name}\b.*?</{name}>", "")
    both = F.arrays_zip(F.regexp_extract_all(html, F.lit(TAG), F.lit(1)).alias("tag"), F.regexp_extract_all(html, F.lit(TAG), F.lit(2)).alias("text"))
    rows = pages.select(F.col(id_col).alias("document_id"), F.posexplode(both).alias("seq", "x")).select("document_id", "seq", F.lower("x.tag").alias("tag"), "x.text")
    own = Window.partitionBy("document_id").orderBy("seq")
    fresh, tag = ~F.col("tag").isin(*INLINE), F.col("tag")
    opens, closes = tag.isin(*REGIONS), tag.isin(*[f"/{x}" for x in REGIONS])
    inside = F.count_if(opens).over(own) > F.count_if(closes).over(own)
    return rows.withColumns({"line": F.count_if(fresh).over(own), "block": F.count_if(fresh & (tag != "br")).over(own), "region": F.when(inside, F.count_if(opens).over(own))})


def spans(rows: DataFrame) -> DataFrame:
    """(document_id, page, block, line, seq, text, size, bold, x0, y0, x1, y1) of tags with text."""
    size = F.coalesce(*[F.when(F.col("tag") == h, F.lit(s)) for h, s in HEADS.items()], F.lit(SIZE))
    y = F.col("line") * STEP
    return rows.filter("text <> ''").select(
        "document_id", F.lit(1).alias("page"), "block", "line", "seq", "text", size.alias("size"), F.col("tag").isin("b", "strong").alias("bold"),
        F.lit(0.0).alias("x0"), y.alias("y0"), (F.char_length("text") * WIDTH).alias("x1"), (y + HEIGHT).alias("y1"),
    )


def regions(rows: DataFrame) -> DataFrame:
    """(document_id, page, region, rows, x0, y0, x1, y1): each list or table, a row of cells for each line with text."""
    cell: Column = T.strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), ""))
    lines = rows.filter("region IS NOT NULL AND text <> ''").groupBy("document_id", "region", "line").agg(cell.alias("cell"), F.max(F.char_length("text") * WIDTH).alias("x1")).filter("cell <> ''")
    cells = F.transform(F.array_sort(F.collect_list(F.struct("line", "cell"))), lambda x: F.array(x["cell"]))
    return lines.groupBy("document_id", "region").agg(cells.alias("rows"), F.lit(0.0).alias("x0"), (F.min("line") * STEP).alias("y0"), F.max("x1").alias("x1"), (F.max("line") * STEP + HEIGHT).alias("y1")).withColumn("page", F.lit(1))
