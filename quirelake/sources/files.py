"""Files in and out. Parsers are given as functions, so that no parser's library is needed to import this."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = "seq int, kind string, text string, level int, page int, source_type string, ocr_confidence double, row_mismatch boolean"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def scan(spark: SparkSession, folder: str, kinds: tuple[str, ...] = ("pdf", "docx")) -> DataFrame:
    """(path, name, content) of a folder's files of some kinds, whatever their case."""
    either = ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in k) for k in kinds)
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{either}}}").load(folder)
    return files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content")


def parse(files: DataFrame, parsers: dict[str, Callable[[bytes], list[dict]]]) -> DataFrame:
    """Blocks of files, by the parser of each one's ending; a failure gives one row with `error` and never ends the job."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["document_id", "seq", "kind", "text", "level", "page", "source_type", "ocr_confidence", "row_mismatch", "error"]
        for frame in frames:
            rows = []
            for name, content in zip(frame["name"], frame["content"], strict=True):
                try:
                    blocks = parsers[name.rsplit(".", 1)[-1].lower()](bytes(content))
                    rows += [(name, i, b["kind"], b["text"], b.get("level"), b.get("page"), b.get("source_type", "digital_text"), b.get("ocr_confidence"), b.get("row_mismatch"), None) for i, b in enumerate(blocks)]
                except Exception as e:  # noqa: BLE001
                    rows.append((name, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            out = pd.DataFrame(rows, columns=columns)
            yield out.astype({"seq": "Int32", "level": "Int32", "page": "Int32", "ocr_confidence": "Float64", "row_mismatch": "boolean"})

    return files.select("name", "content").mapInPandas(run, f"document_id string, {BLOCK}, error string")


def docx_blocks(content: bytes) -> list[dict]:
    """Paragraphs, headings (level 4 at most), list items ('- ' in front) and tables of a Word file's body, in order."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    out = []
    for e in body if body is not None else ():
        if e.tag == f"{_W}p" and text(e).strip():
            style = e.find(f"{_W}pPr/{_W}pStyle")
            heading = re.fullmatch(r"[Hh]eading\s*(\d+)", style.get(f"{_W}val", "")) if style is not None else None
            if heading:
                out.append({"kind": "heading", "text": text(e).strip(), "level": min(int(heading[1]), 4)})
            elif e.find(f"{_W}pPr/{_W}numPr") is not None:
                out.append({"kind": "list", "text": f"- {text(e).strip()}"})
            else:
                out.append({"kind": "paragraph", "text": text(e).strip()})
        elif e.tag == f"{_W}tbl":
            rows = [[text(c).replace("\n", " ").strip() for c in r.findall(f"{_W}tc")] for r in e.findall(f"{_W}tr")]
            width = len(rows[0]) if rows else 0
            lines = [f"| {' | '.join([*r[:width], *[''] * (width - len(r))])} |" for r in rows]
            out.append({"kind": "table", "text": "\n".join([*lines[:1], f"| {' | '.join(['---'] * width)} |", *lines[1:]]), "row_mismatch": any(len(r) != width for r in rows)})
    return out


def ocr_page(words: DataFrame) -> DataFrame:
    """(document_id, page, text, confidence) of recognised words (document_id, page, block, par, line, word, text, conf): lines in order, mean confidence / 100."""
    good = words.filter(F.trim("text") != "")
    lines = good.groupBy("document_id", "page", "block", "par", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda x: x["text"]), " ").alias("t"))
    text = lines.groupBy("document_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "par", "line", "t"))), lambda x: x["t"]), "\n").alias("text"))
    sure = good.filter("conf >= 0").groupBy("document_id", "page").agg((F.avg("conf") / 100).alias("confidence"))
    return text.join(sure, ["document_id", "page"], "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def upscale(dpi, target: float = 300, most: float = 3.0):
    """By how much an image of a resolution is enlarged before recognition."""
    return F.when(dpi < target, F.least(F.lit(target) / dpi, F.lit(most))).otherwise(1.0)


def read_documents(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    """Document JSON files of a folder, one document each; the run's summary file is left out."""
    reader = spark.read.option("multiLine", "true")
    rows = (reader.schema(schema) if schema else reader).json(f"{folder}/*.json")
    return rows.filter(~F.col("_metadata.file_name").isin("ingestion_summary.json"))


def write_documents(chunks: DataFrame, folder: str) -> None:
    """A JSON row per document, its chunks inside."""
    c = F.struct("seq", *[x for x in chunks.columns if x not in ("document_id", "seq")])
    chunks.groupBy("document_id").agg(F.array_sort(F.collect_list(c)).alias("chunks")).write.mode("overwrite").json(folder)


def append_log(rows: DataFrame, folder: str) -> bool:
    """Rows appended to the query log; whether it worked. A failure never reaches the caller."""
    try:
        rows.write.mode("append").parquet(folder)
        return True
    except Exception:  # noqa: BLE001
        return False


def embed(df: DataFrame, model: Callable[[list[str]], tuple[list[list[float]], list[dict[str, float]], list[int]]], text: str = "text") -> DataFrame:
    """df with dense (array), sparse (map) and token_count by a model given as a function of a list of texts; batches of what Arrow brings."""

    @F.pandas_udf("dense array<float>, sparse map<string,float>, token_count int")
    def run(s: pd.Series) -> pd.DataFrame:
        dense, sparse, n = model(s.fillna("").tolist())
        return pd.DataFrame({"dense": dense, "sparse": sparse, "token_count": n})

    return df.withColumn("_e", run(F.col(text))).select("*", "_e.dense", "_e.sparse", "_e.token_count").drop("_e")
