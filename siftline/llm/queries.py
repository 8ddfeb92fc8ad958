"""The pN_ queries with their production parameters, over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import alignment, distinctive, encoding, leakage, lookalike, near_duplicates, neighbours, reading_level, shared_spans, term_counts
from siftline.llm.common import records, table, valid_builds
from siftline.session import cut


def _p1(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "hadiths").withColumn("words", distinctive.words_of("ar.matn", "en", "narrator"))
    return distinctive.log_entropy(records(rows, "words"), "rec_id", "words")


def p1_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Score of every word of every record."""
    return _p1(spark, folder).withColumn("score", F.round("score", 6))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _p1(spark, folder).where((F.col("tf") >= 3) & F.col("df").between(2, 8)).select("rec_id", "term")


def _p2(spark: SparkSession, folder: str) -> DataFrame:
    rows = records(table(spark, folder, "hadiths"), "ar.matn", "ar.sanad")
    sides = F.create_map(F.lit("matn"), "matn", F.lit("sanad"), "sanad")
    texts = cut(rows.select("rec_id", F.explode(sides).alias("fld", "text")).where("length(text) > 0"))
    return shared_spans.shared_spans(texts, "fld", "rec_id", "text")


def p2_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """How much of every field is shared elsewhere, for fields that share anything."""
    return _p2(spark, folder).withColumn("share", F.round("share", 6))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _p2(spark, folder).select("fld", "rec_id")


def _p3(spark: SparkSession, folder: str) -> DataFrame:
    rows = records(table(spark, folder, "hadiths"), "ar.matn", "ar.sanad")
    titles = table(spark, folder, "chapters").where("chapter_id is not null")
    texts = rows.select(F.col("rec_id").alias("id"), F.explode(F.create_map(F.lit("matn"), "matn", F.lit("sanad"), "sanad")).alias("fld", "text"))
    titles = titles.groupBy(F.col("chapter_id").alias("id")).agg(F.max("ar").alias("text")).select("id", F.lit("chapter").alias("fld"), "text")
    return lookalike.consistent(texts.unionByName(titles), ["fld", "id"], "text")


def p3_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every text in its consistent form."""
    return _p3(spark, folder)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.same_look(cut(_p3(spark, folder)), "fld", "id")


P4_LEAST = 0.7


def _p4(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = records(table(spark, folder, "hadiths"), "ar.matn", "en")
    return near_duplicates.similar_sets(near_duplicates.word_sets(rows, "rec_id", "matn", "en"), P4_LEAST)


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Class, group and number of links of every record with words."""
    return near_duplicates.groups(*_p4(spark, folder))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.pairs(*_p4(spark, folder))


def p5_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of sentences with the number of correspondences that join them."""
    rows = records(table(spark, folder, "hadiths"), "ar.matn", "en")
    return alignment.aligned(rows, table(spark, folder, "glossary"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_pairs(spark, folder).select("rec_id", "ar_sent", "en_sent")


P6_LEAST = 0.9


def _p6(spark: SparkSession, folder: str) -> DataFrame:
    dims = valid_builds(table(spark, folder, "manifest")).agg(F.max("dims")).scalar()
    return neighbours.nearest(neighbours.usable(table(spark, folder, "vectors"), dims))


def p6_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most similar vectors of every usable vector."""
    return _p6(spark, folder).withColumn("cosine", F.round("cosine", 6))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.similar_pairs(_p6(spark, folder), P6_LEAST)


def _p7(spark: SparkSession, folder: str) -> DataFrame:
    rows = records(table(spark, folder, "hadiths"), "en")
    cutoff = valid_builds(table(spark, folder, "manifest")).agg(F.max("dfcutoff")).scalar()
    return term_counts.marked(term_counts.term_counts(rows, "en"), rows.agg(F.count("*")).scalar(), cutoff)


def p7_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences, records and mark of every word of en."""
    return _p7(spark, folder)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _p7(spark, folder).where(F.col("mark").isNotNull()).select("term", "mark")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.encoded(table(spark, folder, "documents"), "doc_id", "text")


def p9_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Verified passages with their longest verbatim run and least distance."""
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_leaks(spark, folder).where(F.col("words") >= leakage.RUN).select("doc_id", "item_id").distinct()


def p10_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Level and expected level of every document with a text."""
    told = reading_level.levels(table(spark, folder, "documents"), table(spark, folder, "level_labels"))
    return told.withColumn("difficulty", F.round("difficulty", 3))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_levels(spark, folder).select("doc_id", "level")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_scores": p1_scores,
    "p1_found": p1_found,
    "p2_coverage": p2_coverage,
    "p2_found": p2_found,
    "p3_forms": p3_forms,
    "p3_found": p3_found,
    "p4_groups": p4_groups,
    "p4_found": p4_found,
    "p5_pairs": p5_pairs,
    "p5_found": p5_found,
    "p6_nearest": p6_nearest,
    "p6_found": p6_found,
    "p7_counts": p7_counts,
    "p7_found": p7_found,
    "p8_ids": p8_ids,
    "p9_leaks": p9_leaks,
    "p9_found": p9_found,
    "p10_levels": p10_levels,
    "p10_found": p10_found,
}
