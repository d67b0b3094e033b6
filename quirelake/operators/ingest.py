"""From extracted blocks to flagged chunks. Work is per document: every window is partitioned by it.

Tables: pages (document_id, page, text); lines (document_id, page, seq, text, size, bold); blocks (document_id, seq, kind, text, level, page, source_type,
ocr_confidence, row_mismatch), kind: heading, paragraph, list or table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..shared import written

DEEPEST = 7
LOW_CONFIDENCE = 0.65
OUTLIER = (5, 0.15, 4.0)


def body_size(spans: DataFrame) -> DataFrame:
    """(document_id, body): the font size, to one decimal, with the most text; ties to the smaller; 11.0 without text. spans: document_id, size, text."""
    n = F.sum(F.char_length(T.strip(F.col("text"))))
    sizes = spans.withColumn("size", F.round(F.col("size").cast("double"), 1)).groupBy("document_id", "size").agg(n.alias("n"))
    best = sizes.groupBy("document_id").agg(F.max_by(F.when(F.col("n") > 0, F.col("size")), F.struct("n", -F.col("size"))).alias("body"))
    return best.select("document_id", F.coalesce("body", F.lit(11.0)).alias("body"))


def heading_sizes(spans: DataFrame, most: int = 4) -> DataFrame:
    """(document_id, level, size): distinct sizes of text 12 % above the body's, the largest first, `most` of them."""
    sizes = spans.filter(T.strip(F.col("text")) != "").select("document_id", F.round(F.col("size").cast("double"), 1).alias("size")).distinct().join(body_size(spans), "document_id")
    order = Window.partitionBy("document_id").orderBy(F.desc("size"))
    return sizes.filter(F.col("size") > F.col("body") * 1.12).select("document_id", F.row_number().over(order).alias("level"), "size").filter(F.col("level") <= most)


def page_lines(spans: DataFrame) -> DataFrame:
    """(document_id, page, block, line, text, size, bold, x0, y0, x1, y1): spans put together to lines, those without text left out. Size and weight are those of
    spans with text; the box is that of the line's block. spans: document_id, page, block, line, seq, text, size, bold, x0, y0, x1, y1."""
    solid = T.strip(F.col("text")) != ""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "")
    of = lambda c, f: F.coalesce(f(F.when(solid, F.col(c))), f(F.col(c))).alias(c)
    rows = spans.groupBy("document_id", "page", "block", "line").agg(T.strip(text).alias("text"), of("size", F.max), of("bold", F.bool_or), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    own = Window.partitionBy("document_id", "page", "block")
    return rows.withColumns({c: f(c).over(own) for c, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))}).filter("text <> ''")


def classify_lines(spans: DataFrame, tables: DataFrame, overlap: float = 0.4) -> DataFrame:
    """(document_id, page, seq, kind, text, level, bare_number, row_mismatch): the blocks of digital pages.

    tables: document_id, page, region, rows, x0, y0, x1, y1; those that aren't real tables count as lines, the others come first on their page, as Markdown. Lines of
    blocks of which more than `overlap` lies in a table's padded box are left out: a join by page. A line is a heading by its number or its size (see
    heading_level) if it is shorter than 150 characters; a bare number alone makes none. Lines between headings are one paragraph of their page.
    Documents without spans but with tables are fine; empty tables give no rows."""
    real = tables.filter(T.real_table(F.col("rows")))
    box = dict(zip(("t0", "u0", "t1", "u1"), T.padded_box([F.col(c) for c in ("x0", "y0", "x1", "y1")]), strict=True))
    boxes = real.select("document_id", "page", *[c.alias(k) for k, c in box.items()])
    lines = page_lines(spans)
    share = T.overlap_share([F.col(c) for c in ("x0", "y0", "x1", "y1")], [F.col(c) for c in box])
    hidden = lines.join(boxes, ["document_id", "page"]).filter(share > overlap).select("document_id", "page", "line").distinct()
    tiers = heading_sizes(spans).groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "size"))), lambda x: x["size"]).alias("tiers"))
    rows = lines.join(hidden, ["document_id", "page", "line"], "left_anti").join(body_size(spans), "document_id", "left").join(tiers, "document_id", "left")
    text, n = F.col("text"), F.char_length("text")
    tiers_ = F.coalesce("tiers", F.array().cast("array<double>"))
    dotted, bare = T.dotted_number(text), T.bare_number(text)
    by_size = T.heading_level(F.col("size"), F.col("body"), tiers_, F.lit(""))
    by_dots = F.when(F.col("bold") | (n < 100) | (T.word_count(text) < 12), T.heading_level(F.col("size"), F.col("body"), tiers_, dotted))
    level = F.when(dotted != "", F.coalesce(by_dots, by_size)).when(bare.isNotNull(), F.when(n < 100, by_size)).otherwise(by_size)
    rows = rows.select("document_id", "page", "line", "text", F.when(n < 150, level).alias("level"), F.when(dotted == "", bare).alias("bare_number"))
    own = Window.partitionBy("document_id", "page").orderBy("line")
    head = F.col("level").isNotNull()
    rows = rows.withColumn("part", F.count_if(head | F.coalesce(F.lag("level").over(own).isNotNull(), F.lit(True))).over(own))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    blocks = rows.groupBy("document_id", "page", "part").agg(joined.alias("text"), F.first("level").alias("level"), F.min_by("bare_number", "line").alias("bare_number"))
    blocks = blocks.select("document_id", "page", F.lit(1).alias("last"), "part", F.when(head, "heading").otherwise("paragraph").alias("kind"), "text", "level", "bare_number", F.lit(False).alias("row_mismatch"))
    none = F.lit(None).cast("int")
    first = real.select("document_id", "page", F.lit(0).alias("last"), F.col("region").cast("long").alias("part"), F.lit("table").alias("kind"), T.rows_to_markdown(F.col("rows")).alias("text"), none.alias("level"), none.alias("bare_number"), T.row_mismatch(F.col("rows")).alias("row_mismatch"))
    seq = F.row_number().over(Window.partitionBy("document_id").orderBy("page", "last", "part"))
    return first.unionByName(blocks).withColumn("seq", seq).select("document_id", "page", "seq", "kind", "text", "level", "bare_number", "row_mismatch")


def edge_lines(pages: DataFrame, edge: int = 3, longest: int = 120) -> DataFrame:
    """(document_id, page, line): each page's first and last `edge` lines with text, once."""
    lines = F.filter(F.transform(F.split("text", "\n"), T.strip), lambda x: x != "")
    rows = pages.select("document_id", "page", lines.alias("l"))
    ends = F.array_distinct(F.concat(F.slice("l", 1, edge), F.slice("l", F.greatest(F.size("l") - edge + 1, F.lit(1)), edge)))
    return rows.select("document_id", "page", F.explode(F.when(F.size("l") > 0, ends)).alias("line")).filter(F.char_length("line") <= longest)


def repeated_lines(pages: DataFrame) -> DataFrame:
    """(document_id, key, n): edge lines, digits aside, of documents of three pages or more that are on 60 % of the pages, twice at least. Lines of a page
    that differ only by digits each count."""
    total = pages.groupBy("document_id").agg(F.count_distinct("page").alias("pages")).filter("pages >= 3")
    keys = edge_lines(pages).groupBy("document_id", T.digit_key(F.col("line")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return keys.join(total, "document_id").filter(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("pages") * 0.6))).select("document_id", "key", "n")


def strip_repeated(pages: DataFrame, repeated: DataFrame) -> DataFrame:
    """pages without repeated lines and page numbers."""
    keys = repeated.groupBy("document_id").agg(F.collect_set("key").alias("keys"))
    kept = lambda l: ~F.coalesce(F.array_contains("keys", T.digit_key(l)), F.lit(False)) & ~T.is_page_number(l)  # noqa: E731, E741
    return pages.join(keys, "document_id", "left").withColumn("text", F.array_join(F.filter(F.split("text", "\n"), kept), "\n")).drop("keys")


def frequent_lines(pages: DataFrame, least: int = 3) -> DataFrame:
    """(document_id, line, pages): normalised lines of three characters or more on `least` pages or more."""
    rows = pages.select("document_id", "page", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), T.normalise_title))).alias("line")).filter(F.char_length("line") >= 3)
    return rows.groupBy("document_id", "line").agg(F.count_distinct("page").alias("pages")).filter(F.col("pages") >= least)


def numbered_runs(lines: DataFrame, least: int = 3) -> DataFrame:
    """lines with `run`: the seq of the first line of a run of `least` or more neighbours numbered n, n + 1, ...; else null."""
    order = Window.partitionBy("document_id").orderBy("seq")
    rows = lines.withColumn("number", T.bare_number(F.col("text")))
    rows = rows.withColumn("fresh", F.coalesce((F.col("number") != F.lag("number").over(order) + 1), F.lit(True)) | F.col("number").isNull())
    rows = rows.withColumn("island", F.sum(F.col("fresh").cast("int")).over(order))
    same = Window.partitionBy("document_id", "island")
    run = F.when(F.col("number").isNotNull() & (F.count(F.lit(1)).over(same) >= least), F.min("seq").over(same))
    return rows.withColumn("run", run).drop("fresh", "island")


def collapse_runs(lines: DataFrame) -> DataFrame:
    """Runs of numbered lines as one list block each."""
    rows = numbered_runs(lines).withColumn("at", F.coalesce("run", "seq"))
    return rows.groupBy("document_id", "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n").alias("text"), F.when(F.max("run").isNotNull(), "list").otherwise(F.first("kind")).alias("kind"), F.min("page").alias("page")).withColumnRenamed("at", "seq")


def document_title(blocks: DataFrame, stems: DataFrame) -> DataFrame:
    """(document_id, title): the first level-1 heading under 120 characters without a number; else the first line so short; else the file's stem."""
    line = T.strip(F.substring_index("text", "\n", 1))
    good = (F.char_length(line) < 120) & (line != "")
    heading = F.when((F.col("kind") == "heading") & (F.col("level") == 1) & good & (T.dotted_number(line) == "") & T.bare_number(line).isNull(), F.struct("seq", line.alias("t")))
    para = F.when((F.col("kind") == "paragraph") & good, F.struct("seq", line.alias("t")))
    found = blocks.groupBy("document_id").agg(F.min(heading).alias("h"), F.min(para).alias("p"))
    return stems.join(found, "document_id", "left").select("document_id", F.coalesce("h.t", "p.t", "stem").alias("title"))


def effective_date(blocks: DataFrame, within: int = 40) -> DataFrame:
    """(document_id, effective_date): what follows 'effective date' in the first blocks; with a digit, under 40 characters."""
    value = T.strip(F.regexp_extract("text", r"(?i)effective\s*(?:date|from)?\s*[:\-]\s*([^\n|]+)", 1))
    rows = blocks.filter(F.col("seq") < within).withColumn("v", value).filter((F.char_length("v") < 40) & F.col("v").rlike("[0-9]"))
    return rows.groupBy("document_id").agg(F.min_by("v", "seq").alias("effective_date"))


def section_paths(blocks: DataFrame, titles: DataFrame) -> DataFrame:
    """blocks other than headings with section (its number in the document) and section_path: the title, then the headings above.

    The heading above at level l is the last of that level, unless one of a lesser level came after it: a window per level instead of a stack. The first
    level-1 heading that equals the title is left out."""
    order = Window.partitionBy("document_id").orderBy("seq")
    rows = blocks.join(titles.select("document_id", "title"), "document_id")
    is_title = F.when((F.col("kind") == "heading") & (F.col("level") == 1), F.lower(T.strip(F.col("text"))) == F.lower(T.strip(F.col("title"))))
    rows = rows.withColumn("same", F.coalesce(is_title, F.lit(False)).cast("int"))
    rows = rows.withColumn("nth", F.sum("same").over(order)).filter(~((F.col("same") == 1) & (F.col("nth") == 1)))
    head = F.col("kind") == "heading"
    for k in range(1, DEEPEST + 1):
        rows = rows.withColumn(f"h{k}", F.last(F.when(head & (F.col("level") == k), F.struct("seq", T.strip(F.col("text")).alias("t"))), ignorenulls=True).over(order))
    alive = lambda k: F.when(F.col(f"h{k}").isNotNull() & (F.col(f"h{k}.seq") > F.greatest(F.lit(-1), F.lit(-1), *[F.coalesce(F.col(f"h{j}.seq"), F.lit(-1)) for j in range(1, k)])), F.col(f"h{k}.t"))
    path = F.concat_ws(" > ", "title", *[alive(k) for k in range(1, DEEPEST + 1)])
    out = rows.withColumns({"section": F.sum(head.cast("int")).over(order), "section_path": path}).filter(~head)
    return out.drop("same", "nth", "title", *[f"h{k}" for k in range(1, DEEPEST + 1)])


def units(blocks: DataFrame) -> DataFrame:
    """Per section: tables one by one, and prose between them as one unit; FAQ sections as question and answer pairs.

    (document_id, section, unit, section_path, chunk_type, source_type, ocr_confidence, page, row_mismatch, parts)."""
    within = Window.partitionBy("document_id", "section").orderBy("seq")
    whole = Window.partitionBy("document_id", "section")
    q, a, table = T.is_question(F.col("text")), T.is_answer(F.col("text")), F.col("kind") == "table"
    rows = blocks.withColumns({"q": q.cast("int"), "a": a.cast("int")})
    nq, na, n = (F.sum("q").over(whole), F.sum("a").over(whole), F.count(F.lit(1)).over(whole))
    rows = rows.withColumn("faq", (nq >= 1) & (na >= 1) & (nq + na >= 0.4 * n))
    edge = F.when(F.col("faq"), F.col("q") == 1).otherwise(table | F.coalesce(F.lag(table).over(within), F.lit(False)))
    rows = rows.withColumn("unit", F.sum(edge.cast("int")).over(within))
    kind = F.when(F.first("faq"), "qa_pair").when(F.bool_or(table), "table").otherwise("prose")
    return rows.groupBy("document_id", "section", "unit", "section_path").agg(
        kind.alias("chunk_type"), F.when(F.bool_or(F.col("source_type") == "ocr"), "ocr").otherwise("digital_text").alias("source_type"), F.min("ocr_confidence").alias("ocr_confidence"),
        F.min("page").alias("page"), F.bool_or(F.coalesce("row_mismatch", F.lit(False))).alias("row_mismatch"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]).alias("parts"),
    )


def pack(parts: Column, budget: Column) -> Column:
    """Texts packed in order into pieces of at most `budget` estimated tokens. A text that is too large stands alone, cut at sentences; a sentence never is."""
    return T.let(budget, lambda most: _pack(parts, most))


def _pack(parts: Column, budget: Column) -> Column:
    tokens = T.token_estimate
    one = lambda t, gap, own, n: F.struct(t.alias("t"), F.lit(gap).alias("gap"), own.alias("own"), n.alias("n"))
    # own tells the sentences of a large text (its number) from whole texts (-1); pieces don't mix them. Each text's tokens are counted once.
    fine = F.flatten(F.transform(parts, lambda p, i: T.let(tokens(p), lambda n: F.when(n <= budget, F.array(one(p, "\n\n", F.lit(-1), n))).otherwise(F.transform(T.sentences(p), lambda s: one(s, " ", i, tokens(s)))))))
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"), F.lit(-1).alias("own"))

    def step(acc: Column, x: Column) -> Column:
        n = x["n"]
        fresh = acc["now"] == ""
        full = ~fresh & ((acc["n"] + n > budget) | (acc["own"] != x["own"]))
        begun = F.struct(F.concat(acc["done"], F.array(acc["now"])).alias("done"), x["t"].alias("now"), n.alias("n"), x["own"].alias("own"))
        more = F.struct(acc["done"].alias("done"), F.when(fresh, x["t"]).otherwise(F.concat(acc["now"], x["gap"], x["t"])).alias("now"), (acc["n"] + n).alias("n"), x["own"].alias("own"))
        return F.when(full, begun).otherwise(more)

    return F.aggregate(fine, zero, step, lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["now"]))))


def chunk(units_: DataFrame, prefixes: DataFrame, tokens: int = 600) -> DataFrame:
    """(document_id, seq, chunk_id, section_path, chunk_type, source_type, ocr_confidence, page, row_mismatch, text, token_count, content_hash).

    Prose above the budget is packed into pieces, each under its section's path; tables and pairs stay whole. Chunks are numbered over the document."""
    joined = F.array_join("parts", "\n\n")
    budget = F.greatest(F.lit(tokens) - T.token_estimate(F.col("section_path")) - 10, F.lit(100))
    split = F.transform(pack(F.col("parts"), budget), lambda p: F.concat(F.col("section_path"), F.lit("\n\n"), p))
    pieces = F.when((F.col("chunk_type") == "prose") & (T.token_estimate(joined) > tokens), split).otherwise(F.array(joined))
    rows = units_.select("*", F.posexplode(pieces).alias("piece", "text")).join(prefixes, "document_id")
    nth = F.row_number().over(Window.partitionBy("document_id").orderBy("section", "unit", "piece"))
    return rows.select(
        "document_id", nth.alias("seq"), F.concat("prefix", F.lit("_"), F.lpad(nth.cast("string"), 4, "0")).alias("chunk_id"), "section_path", "chunk_type", "source_type", "ocr_confidence", "page", "row_mismatch",
        "text", T.token_estimate(F.col("text")).alias("token_count"), T.content_hash(F.col("text")).alias("content_hash"),
    )


def median_tokens(chunks: DataFrame) -> DataFrame:
    """(document_id, median): of the token counts of all but tables; 0.0 without any."""
    return chunks.groupBy("document_id").agg(F.coalesce(F.median(F.when(F.col("chunk_type") != "table", F.col("token_count"))), F.lit(0.0)).alias("median"))


def qa_flags(chunks: DataFrame) -> DataFrame:
    """chunks with qa_flags, in this order: empty, length_outlier, garbled_text, table_conversion_issue, low_ocr_confidence."""
    few, low, high = OUTLIER
    median = F.coalesce(F.median(F.when(F.col("chunk_type") != "table", F.col("token_count"))).over(Window.partitionBy("document_id")), F.lit(0.0))
    empty, n, table = ~T.has_text(F.col("text")), F.col("token_count"), F.col("chunk_type") == "table"
    odd = ~table & ((n < few) | ((F.col("median") > 0) & ((n < low * F.col("median")) | (n > high * F.col("median")))))
    flags = F.array(F.when(empty, "empty"), F.when(~empty & odd, "length_outlier"), F.when(~table & T.garbled(F.col("text")), "garbled_text"), F.when(table & F.col("row_mismatch"), "table_conversion_issue"), F.when(F.col("ocr_confidence") < LOW_CONFIDENCE, "low_ocr_confidence"))
    return chunks.withColumn("median", median).withColumn("qa_flags", F.filter(flags, lambda x: x.isNotNull())).drop("median")


def flag_totals(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.explode("qa_flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("chunks"))


def structure_status(blocks: DataFrame) -> DataFrame:
    """(document_id, status, reason): needs_review without blocks of text, with over 30 % of OCR confidences under 0.65, or without headings; else ok."""
    share = F.avg((F.col("ocr_confidence") < LOW_CONFIDENCE).cast("int"))
    by = blocks.groupBy("document_id").agg(F.count_if(T.has_text(F.col("text"))).alias("n"), share.alias("low"), F.count_if(F.col("kind") == "heading").alias("h"))
    reason = F.when(F.col("n") == 0, "no content extracted").when(F.col("low") > 0.3, "low OCR confidence").when(F.col("h") == 0, "no headings detected")
    return by.select("document_id", F.when(reason.isNull(), "ok").otherwise("needs_review").alias("status"), reason.alias("reason"))


def ingestion_summary(chunks: DataFrame, statuses: DataFrame) -> DataFrame:
    """One row: documents, chunks, pages by source, documents to review; flag totals as a map."""
    page = F.struct("document_id", "page")
    pages = lambda k: F.count_distinct(F.when((F.col("source_type") == k) & F.col("page").isNotNull(), page))
    chunks = written(chunks.select("document_id", "source_type", "page", "qa_flags"), "chunk-flags")  # made once
    a = chunks.agg(F.count_distinct("document_id").alias("documents"), F.count(F.lit(1)).alias("chunks"), pages("ocr").alias("ocr_pages"), pages("digital_text").alias("digital_pages"))
    f = flag_totals(chunks).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("flag", "chunks")))).alias("flags"))
    return a.join(f, F.lit(True)).join(statuses.agg(F.count_if(F.col("status") == "needs_review").alias("to_review")), F.lit(True))  # one row each


def process(blocks: DataFrame, stems: DataFrame, tokens: int = 600) -> DataFrame:
    """Blocks to flagged chunks. stems: document_id, stem (the file's name without its ending). Blank blocks go unless they are tables."""
    kept = blocks.filter(T.has_text(F.col("text")) | (F.col("kind") == "table"))
    titles = document_title(kept, stems)
    prefixes = stems.select("document_id", T.id_prefix(F.col("stem")).alias("prefix"))
    return qa_flags(chunk(units(section_paths(kept, titles)), prefixes, tokens))
