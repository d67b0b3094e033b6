"""Lines of digital pages to blocks: tables and their boxes, numbers, sizes, paragraphs."""

from pyspark.sql import functions as F

from quirelake.operators import ingest as I
from quirelake.sources import html as H

SPANS = "document_id long, page int, block int, line int, seq int, text string, size double, bold boolean, x0 double, y0 double, x1 double, y1 double"
TABLES = "document_id long, page int, region int, rows array<array<string>>, x0 double, y0 double, x1 double, y1 double"


def line(n, text, size=11.0, bold=False, page=1, block=None, doc=1):
    return (doc, page, n if block is None else block, n, 0, text, size, bold, 0.0, 20.0 * n, 100.0, 20.0 * n + 10)


def test_classify_lines(spark):
    long = " ".join(["word"] * 40)
    spans = [
        line(0, "The Policy", 20.0), line(1, "1.2 Scope"), line(2, "body text " * 20), line(3, "3. First item"), line(4, "more"), line(5, "4. Chapter", 20.0), line(6, "Head | er", 11.0),
        line(7, "in the table"), line(20, "after"), line(21, "2.1 " + long), line(22, "Larger than all", 15.0), line(23, "  "), line(24, "next page", page=2), line(25, "x" * 160, 20.0, page=2), line(0, "lone", doc=2),
        (1, 1, 26, 26, 0, "two ", 11.0, False, 0.0, 900.0, 9.0, 910.0), (1, 1, 26, 26, 1, "spans", 11.0, True, 0.0, 900.0, 9.0, 910.0), (1, 1, 26, 26, 2, "   ", 40.0, False, 0.0, 900.0, 9.0, 910.0),
    ]
    tables = [(1, 1, 0, [["a", "b"], ["1", None]], 0.0, 138.0, 100.0, 150.0), (1, 1, 1, [["1.1 OBJECTIVE"]], 0.0, 400.0, 100.0, 450.0), (3, 4, 0, [["h", "k"], ["only", "table", "odd"]], 0.0, 0.0, 9.0, 9.0)]
    got = [tuple(r)[:7] + (r.row_mismatch,) for r in I.classify_lines(spark.createDataFrame(spans, SPANS), spark.createDataFrame(tables, TABLES)).orderBy("document_id", "seq").collect()]
    body = ("body text " * 20).strip()
    assert got == [
        (1, 1, 1, "table", "| a | b |\n| --- | --- |\n| 1 |  |", None, None, False),
        (1, 1, 2, "heading", "The Policy", 1, None, False),
        (1, 1, 3, "heading", "1.2 Scope", 3, None, False),
        (1, 1, 4, "paragraph", f"{body}\n3. First item\nmore", None, None, False),
        (1, 1, 5, "heading", "4. Chapter", 1, 4, False),
        (1, 1, 6, "paragraph", f"after\n2.1 {long}", None, None, False),
        (1, 1, 7, "heading", "Larger than all", 2, None, False),
        (1, 1, 8, "paragraph", "two spans", None, None, False),
        (1, 2, 9, "paragraph", "next page\n" + "x" * 160, None, None, False),
        (2, 1, 1, "paragraph", "lone", None, None, False),
        (3, 4, 1, "table", "| h | k |\n| --- | --- |\n| only | table |", None, None, True),
    ]
    assert I.classify_lines(spark.createDataFrame([], SPANS), spark.createDataFrame([], TABLES)).count() == 0


def test_pages_as_spans(spark):
    page = "<html><head><title>no</title></head><body><h1>Top</h1><script>var a='<p>no</p>'</script><p>one <b>two</b> three<br>four<ul><li><a href='x'>A</a></li><li></li><li>B</li></ul><p>end"
    rows = H.tags(spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "no tags")], "page_id long, html string"))
    blocks = I.classify_lines(H.spans(rows), H.regions(rows)).orderBy("document_id", "seq").collect()
    assert [(r.document_id, r.kind, r.text) for r in blocks] == [(1, "table", "| A |\n| --- |\n| B |"), (1, "heading", "Top"), (1, "paragraph", "one two three\nfour\nend")]
    assert [r.rows for r in H.regions(rows).collect()] == [[["A"], ["B"]]] and rows.filter(F.col("text").contains("no")).count() == 0
