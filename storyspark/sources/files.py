"""Readers of books (S1-S5, S15) and a pluggable source by name (U4)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.batches import small_batches
from ..functions.textfn import strip
from ..operators.text import clean_text
from .charsets import detect
from .markup import elements

EXTENSIONS = ("txt", "epub", "mobi", "html")
LIMIT_BYTES = 100 << 20


def read_text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Whole plain-text files as ``(path, text)``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_directory(spark: SparkSession, path: str, pattern: str = "*.txt", extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """Files of one folder as ``(path, title, extension, size, content)``; the title is the file's stem."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").load(path)
    name = r"([^/]+)\.([^./]+)$"
    rows = rows.select("path", F.regexp_extract("path", name, 1).alias("title"), F.lower(F.regexp_extract("path", name, 2)).alias("extension"), F.col("length").alias("size"), "content")
    return rows.where(F.col("extension").isin(*extensions))


#: Letters of two bytes in UTF-8 that hardly ever stand in texts, while other character sets have usual signs for these bytes.
UNUSUAL = "[\u0180-\u036f\u03aa\u03ab\u03b0\u0460-\u052f]"


def decode_charset(rows: DataFrame, content: str = "content") -> DataFrame:
    """Add ``text``, ``encoding``, ``error`` and ``sure``. Valid UTF-8 without zero bytes or ``UNUSUAL`` letters never leaves the JVM.

    Other bytes are read in the character set in which they make the likeliest text, see ``charsets``; ``sure`` is false
    where another comes close. Null content has an error. Columns of these names are replaced.
    """
    small_batches(rows.sparkSession)
    rows = rows.drop(*({"text", "encoding", "error", "sure"} - {content}))
    string = F.col(content).cast("string")
    fine = F.coalesce(F.is_valid_utf8(string) & ~F.contains(string, F.lit("\0")) & ~F.rlike(string, F.lit(UNUSUAL)), F.lit(False))
    utf8 = rows.where(fine).withColumns({"text": string, "encoding": F.lit("utf-8"), "error": F.lit(None).cast("string"), "sure": F.lit(True)})
    at = rows.columns.index(content)
    added = [("text", pa.string()), ("encoding", pa.string()), ("error", pa.string()), ("sure", pa.bool_())]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if data is None else detect(data) for data in batch.column(at).to_pylist()]
            out = [(None, None, "no known encoding fits", False) if f is None else (f[0], f[1], None, f[2]) for f in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([o[i] for o in out], t) for i, (_, t) in enumerate(added))], [*batch.schema.names, *(n for n, _ in added)])

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", text string, encoding string, error string, sure boolean"
    return utf8.unionByName(rows.where(~fine).mapInArrow(told, schema))


def catalog_files(files: DataFrame, limit: int = LIMIT_BYTES, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """Add ``file_hash``, ``file_size`` and ``reject_reason`` (null where the file is accepted)."""
    size = F.length("content")
    reason = F.when(~F.col("extension").isin(*extensions), "unsupported format").when(size > limit, "too large").when(size == 0, "empty")
    return files.withColumns({"file_hash": F.md5("content"), "file_size": size, "reject_reason": reason})


def _entities_read(text: Column) -> Column:
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return clean_text(text)


def html_text(html: str | Column) -> Column:
    """Text of a piece of HTML: tags become spaces, a few entities are read, and it is cleaned."""
    return _entities_read(F.regexp_replace(html, r"(?is)<[^>]+>", " "))


#: Where a page's title and its body are looked for, in this order; the empty one is the whole page.
TITLES = ("h1", "h2", "h3", "title")
BODIES = ("main", "article", ".chapter", ".content", "#content", "body", "")


_PARTS = StructType([StructField("title", StringType()), StructField("body", StringType())])


def _parts(pages: pa.Array) -> pa.Array:
    out = []
    for page in pages.to_pylist():
        title = body = None
        if page is not None:
            heads, texts = elements(page, TITLES, ""), elements(page, BODIES)
            title = next((heads[s] for s in TITLES if heads.get(s)), None)
            body = next((texts[s] for s in BODIES if texts.get(s)), None)
        out.append({"title": title, "body": body})
    return pa.array(out, pa.struct([("title", pa.string()), ("body", pa.string())]))


def html_chapters(pages: DataFrame, book: str | None = None, order: str = "page_id", html: str = "html", least: int = 100) -> DataFrame:
    """``(order, title, content)`` of pages with more than ``least`` characters of text.

    The title is the first h1, else h2, h3, title; the body the first main, article, element of class
    chapter or content, element of id content, body, else the whole page. Elements are taken whole, with what is nested in
    them; an empty one counts as missing. The ``book`` column is kept where one is named. Null pages are left out.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(*([book] if book else []), order, F.arrow_udf(_parts, _PARTS)(F.col(html)).alias("__parts"))
    rows = rows.select(*([book] if book else []), order, strip(F.col("__parts.title")).alias("title"), _entities_read(F.col("__parts.body")).alias("content"))
    return rows.where(F.length("content") > least)


_READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"txt": read_text_corpus}


def register_source(name: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
    _READERS[name.lower()] = reader


def source(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """A reader by name, whatever its case."""
    if name.lower() not in _READERS:
        raise ValueError(f"unsupported format: {name}")
    return _READERS[name.lower()]


def relational(rows: DataFrame, columns: list[str], where: str | None = None) -> DataFrame:
    """Columns or expressions of the rows that fit; both reach the scan, whatever it reads."""
    return (rows.where(where) if where else rows).selectExpr(*columns)


def read_relational(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A table scan over a pool of connections, dealt out by ranges of a key."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts)
