"""Reading and writing: domain tables, marked-up pages, book files, catalogue, manifest."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.markup import book_number, clean_page

RECORD = (
    "n int, suffix string, ref string, slug string, inBook int, inBookRef string, ch int, narrator string, en string, "
    "ar struct<sanad:string,matn:string>, grade string, gradeAr string, grader string"
)
BOOK = (
    "collection string, book struct<number:int,english:string,arabic:string>, "
    "chapters array<struct<n:int,nAr:int,en:string,ar:string,intro:string>>, "
    f"hadiths array<struct<{', '.join(f'{n}:{k}' for n, k in (f.split(' ', 1) for f in RECORD.split(', ')))}>>"
)
CATALOGUE = (
    "collections array<struct<id:string,english:string,arabic:string,hadiths:int,chapters:int,"
    "books:array<struct<number:int,english:string,arabic:string,hadiths:int,chapters:int,file:string>>>>"
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest_records(spark: SparkSession, folder: str, *fields: str, only: DataFrame | None = None) -> DataFrame:
    """hadiths with one row per rec_id, the last scraped one; only the named fields are read and moved (all, if none is).
    only: the rec_ids wanted; other rows are dropped before they are compared."""
    rows = table(spark, folder, "hadiths").where("rec_id is not null")
    if only is not None:
        rows = rows.join(only.select("rec_id").distinct(), "rec_id", "left_semi")
    others = [c for c in fields or rows.columns if c not in ("rec_id", "scraped_at")]
    if not others:
        return rows.select("rec_id").distinct()
    best = F.max(F.struct("scraped_at", *others)).alias("b")
    return rows.groupBy("rec_id").agg(best).select("rec_id", *[f"b.{c}" for c in others])


def pages(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, book_number, html) of raw pages, one file each, in the order of their folders and numbers; marks at the start
    dropped, line ends as one."""
    read = spark.read.text(pattern, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return read.select("path", book_number(F.col("path")).alias("book_number"), clean_page(F.col("value")).alias("html")).orderBy(F.regexp_extract("path", "^(.*)/", 1), "book_number", "path")


def book_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Book files (one JSON object each; .gz is read as well) with the declared types: nothing is inferred."""
    return spark.read.schema(BOOK).json(pattern)


def book_records(books: DataFrame) -> DataFrame:
    """One row per record of book files, with its chapter's titles found by place, without a shuffle."""
    rows = books.select("collection", F.col("book.number").alias("book_number"), "chapters", F.posexplode("hadiths").alias("pos", "h"))
    chapter = F.when(F.col("h.ch") >= 0, F.get(F.col("chapters"), F.col("h.ch")))
    return rows.select("collection", "book_number", "pos", "h.*", chapter["ar"].alias("chapter_ar"), chapter["en"].alias("chapter_en"))


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    read = spark.read.schema(CATALOGUE).option("multiLine", True).json(path)
    rows = read.select(F.explode("collections").alias("c")).select(F.col("c.id").alias("collection"), F.explode("c.books").alias("b"))
    return rows.select("collection", F.col("b.number").alias("book_number"), "b.english", "b.arabic", "b.hadiths", "b.chapters", "b.file")


def write_books(records: DataFrame, path: str, kind: str = "parquet", compression: str = "zstd") -> None:
    """Records partitioned by collection and book, so that reading a book reads its folder only."""
    records.write.mode("overwrite").option("compression", compression).partitionBy("collection", "book_number").format(kind).save(path)


def read_book(spark: SparkSession, path: str, wanted: DataFrame | list[tuple[str, int]], kind: str = "parquet") -> DataFrame:
    """Records of some books of write_books(): only their folders are read. A DataFrame of (collection, book_number), such
    as the books of ranked hits, prunes at run time by the small side of its join."""
    rows = spark.read.format(kind).load(path)
    if isinstance(wanted, DataFrame):
        return rows.join(F.broadcast(wanted.select("collection", "book_number").distinct()), ["collection", "book_number"], "left_semi")
    fits = F.lit(False)
    for collection, book in wanted:
        fits = fits | ((F.col("collection") == collection) & (F.col("book_number") == book))
    return rows.where(fits)


def write_catalogue(books: DataFrame, path: str, compression: str = "none") -> None:
    """The catalogue file: collections with their totals and books, in the form that catalogue() reads. One row a book."""
    book = F.struct(F.col("book_number").alias("number"), "english", "arabic", "hadiths", "chapters", F.col("source_file").alias("file"))
    by = books.groupBy(F.col("collection").alias("id")).agg(F.sum("hadiths").alias("hadiths"), F.sum("chapters").alias("chapters"), F.array_sort(F.collect_list(book)).alias("books"))
    whole = by.agg(F.array_sort(F.collect_list(F.struct("id", "hadiths", "chapters", "books"))).alias("collections"))
    whole.coalesce(1).write.mode("overwrite").option("compression", compression).json(path)


def write_topics(payload: DataFrame, path: str, compression: str = "gzip") -> None:
    """The topics file of browse.topics_payload(): one JSON object."""
    payload.coalesce(1).write.mode("overwrite").option("compression", compression).json(path)


def merge_manifest(path: str, **sections: object) -> dict:
    """Set sections of a small JSON manifest and keep the others."""
    at = Path(path)
    manifest = json.loads(at.read_text()) if at.exists() else {}
    manifest |= sections
    at.write_text(json.dumps(manifest, indent=2, ensure_ascii=False, sort_keys=True))
    return manifest
