"""Browsing: catalogue roll-ups, topics, reading a book page by page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.display import topic_key

PAGE = 40
BAB = "باب"


def catalogue(books: DataFrame) -> DataFrame:
    """(collection, book_number, hadiths, chapters, books): per book, per collection and in all, in one pass."""
    sums = books.rollup("collection", "book_number").agg(
        F.sum("hadiths").alias("hadiths"), F.sum("chapters").alias("chapters"), F.count("*").alias("books"), F.grouping_id().alias("level")
    )
    return sums


def doc_offsets(books: DataFrame, size: str = "hadiths") -> DataFrame:
    """(collection, book_number, first_doc): running offsets over the catalogue, which has a row per book."""
    before = Window.orderBy("collection", "book_number").rowsBetween(Window.unboundedPreceding, -1)
    return books.select("collection", "book_number", F.coalesce(F.sum(size).over(before), F.lit(0)).alias("first_doc"))


def bare_title(title: Column) -> Column:
    return F.regexp_replace(F.coalesce(title, F.lit("")), f"^{BAB}\\s+", "")


def topics(chapters: DataFrame, records: DataFrame) -> DataFrame:
    """(collection, book_number, ch, n, ar, en, hadiths): chapters with a name, and how many records each has."""
    counts = records.where(F.col("ch") >= 0).groupBy("collection", "book_number", "ch").agg(F.count("*").alias("hadiths"))
    bare = F.regexp_replace(F.coalesce("ar", F.lit("")), f"^{BAB}\\s*", "")
    named = chapters.where((F.length(bare) > 2) | (F.length(F.coalesce("en", F.lit(""))) > 2))
    number = F.coalesce(F.nullif("nar", F.lit(0)), F.nullif("n", F.lit(0)), F.col("ch") + 1)
    return named.join(counts, ["collection", "book_number", "ch"], "left").select(
        "collection", "book_number", "ch", number.alias("n"), "ar", "en", F.coalesce("hadiths", F.lit(0)).alias("hadiths")
    )


def keyed_topics(found: DataFrame, books: DataFrame) -> DataFrame:
    """Topics with the key that filters look into: both titles, book and collection."""
    names = books.select("collection", "book_number", F.col("english").alias("_book"), F.col("arabic").alias("_libro"))
    rows = found.join(names, ["collection", "book_number"], "left")
    parts = F.array("ar", "en", "_book", "_libro", "collection")
    return rows.withColumn("key", topic_key(F.array_join(F.array_compact(parts), " "))).drop("_book", "_libro")


def filter_topics(keyed: DataFrame, needle: str) -> DataFrame:
    """Topics whose key contains the needle's key; an empty needle keeps all."""
    wanted = topic_key(F.lit(needle))
    return keyed.where((wanted == "") | F.contains(F.col("key"), wanted))


def headed(records: DataFrame, chapters: DataFrame) -> DataFrame:
    """Records of books with the heading that stands before each: where the chapter changes and has a name."""
    along = Window.partitionBy("collection", "book_number").orderBy("pos", "rec_id")
    changed = F.col("ch") != F.lag("ch", 1, -2).over(along)
    titles = chapters.select("collection", "book_number", "ch", F.coalesce(F.nullif("en", F.lit("")), F.nullif("ar", F.lit(""))).alias("_title"))
    rows = records.withColumn("_starts", F.coalesce(changed, F.lit(True)) & (F.col("ch") >= 0))
    return rows.join(titles, ["collection", "book_number", "ch"], "left").withColumn("heading", F.when(F.col("_starts"), F.col("_title"))).drop("_starts", "_title")


def chapter_start(records: DataFrame) -> DataFrame:
    """(collection, book_number, ch, start): place of the first record of every chapter."""
    return records.where(F.col("ch") >= 0).groupBy("collection", "book_number", "ch").agg(F.min("pos").alias("start"))


def page(rows: DataFrame, collection: str, book: int, start: int, size: int = PAGE) -> DataFrame:
    """The next rows of a book from a place on: a keyset page, so no rows are skipped over."""
    return rows.where((F.col("collection") == collection) & (F.col("book_number") == book) & (F.col("pos") >= start)).orderBy("pos", "rec_id").limit(size)


def collection_order(collection: Column, order: list[str]) -> Column:
    """Place in a fixed order; unknown collections come last."""
    at = F.array_position(F.array(*map(F.lit, order)), collection)
    return F.when(at == 0, len(order) + 1).otherwise(at)


def pointers(records: DataFrame, key: str = "rec_id") -> DataFrame:
    """(doc_id, collection, book, pos): where every record stands, as written beside the word index."""
    return records.select(F.col(key).alias("doc_id"), "collection", F.col("book_number").alias("book"), "pos")


def topics_payload(rows: DataFrame, built: str) -> DataFrame:
    """One row (built, count, collections, topics) of topics(): a row per chapter with a name, so of a catalogue's size."""
    listed = F.array_sort(F.collect_list(F.struct("collection", "book_number", "ch", "n", "ar", "en", "hadiths")))
    return rows.agg(F.count("*").alias("count"), F.array_sort(F.collect_set("collection")).alias("collections"), listed.alias("topics")).select(
        F.lit(built).alias("built"), "count", "collections", "topics"
    )
