"""Measuring a ranking, and checks of the data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.session import cut, parallelism

SEED, SAMPLES = 20260918, 150


def mulberry32(seed: int) -> Iterator[float]:
    """The public 32-bit generator of that name, in [0, 1)."""
    state = seed & 0xFFFFFFFF
    while True:
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = (state ^ state >> 15) * (state | 1) & 0xFFFFFFFF
        t ^= t + ((t ^ t >> 7) * (t | 61) & 0xFFFFFFFF) & 0xFFFFFFFF
        yield ((t ^ t >> 14) & 0xFFFFFFFF) / 4294967296


def rare_terms(placed: DataFrame, vocabulary: DataFrame, most: int = 3, shortest: int = 4, least: int = 2, top: int = 20) -> DataFrame:
    """(doc_id, term, df, nth): a document's rarest terms of some length that other documents share; of equally rare
    ones, those that come first. Documents with fewer than most such terms have none. placed: lexical.first_places()."""
    fit = vocabulary.where((F.length("term") >= shortest) & F.col("df").between(least, top))
    own = Window.partitionBy("doc_id").orderBy("df", "place")
    rows = placed.join(fit, "term").select("doc_id", "term", "df", F.row_number().over(own).alias("nth")).where(F.col("nth") <= most)
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy("doc_id"))).where(F.col("_n") == most).drop("_n")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with their place in an order, counted from 0: by ranges, of which only the sizes come to the driver."""
    parts = rows.repartitionByRange(parallelism(rows.sparkSession), *order).withColumn("_part", F.spark_partition_id())
    parts = cut(parts)
    sizes, before = [], 0
    for r in parts.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():
        sizes.append((r["_part"], before))
        before += r.n
    starts = F.broadcast(rows.sparkSession.createDataFrame(sizes, "_part int, _before bigint"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_nth", nth).join(starts, "_part").withColumn("place", F.col("_before") + F.col("_nth") - 1).drop("_part", "_nth", "_before")


def drawn(size: int, samples: int = SAMPLES, attempts: int = 3, seed: int = SEED) -> list[tuple[int, int]]:
    """(attempt, place): the places that the seeded generator draws, with replacement, at most attempts per sample."""
    draw = mulberry32(seed)
    return [(i, int(next(draw) * size)) for i in range(samples * attempts)]


def accepted(attempts: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """The first samples of the attempts that fit, numbered anew; attempts are few, so one task may order them."""
    nth = F.row_number().over(Window.orderBy("attempt")) - 1
    return attempts.withColumn("draw", nth).where(F.col("draw") < samples)


def first_notes(notes: DataFrame, *order: str, text: str = "note", most: int = 20) -> DataFrame:
    """(nth, note): the first notes of an order, and how many more there are as a last one."""
    total = notes.count()
    rows = notes.orderBy(*order).limit(most).select(F.col(text).alias("note"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    listed = rows.select((F.row_number().over(Window.orderBy(*[f"_o{i}" for i in range(len(order))]))).alias("nth"), "note")
    if total <= most:
        return listed
    return listed.unionByName(notes.sparkSession.createDataFrame([(most + 1, f"… {total - most} more")], "nth int, note string"))


def present(texts: DataFrame, markers: DataFrame, block_bytes: int = 8 << 20) -> DataFrame:
    """(query_id) of markers (query_id, phrase, words) that the corpus holds: the phrase within some text, or every one
    of its words somewhere in the texts, as parts of words count too. texts: (text), words joined by single spaces.

    The markers are stated: they go to the texts in blocks of bounded size as one automaton, every text is read once a
    block, and a task hands on each phrase or word that it met once."""
    spark = texts.sparkSession

    def met(shared):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for needle in shared.value:
                automaton.add_word(needle, needle)
            automaton.make_automaton()
            seen: set[str] = set()
            for batch in batches:
                for text in batch["text"]:
                    seen.update(found for _, found in automaton.iter(text))
            yield pd.DataFrame({"needle": sorted(seen)})

        return run

    needles = markers.select(F.explode(F.array_union(F.array("phrase"), F.col("words"))).alias("n")).where("n <> ''").distinct()
    block, size, found = [], 0, None
    for row in [*needles.orderBy("n").toLocalIterator(), None]:
        if row is not None:
            block.append(row.n)
            size += len(row.n.encode())
        if block and (row is None or size > block_bytes):
            part = texts.select("text").mapInPandas(met(spark.sparkContext.broadcast(block)), "needle string")
            found = part if found is None else found.unionByName(part)
            block, size = [], 0
    if found is None:
        return markers.select("query_id").limit(0)
    found = cut(found.distinct())
    whole = markers.join(found, F.col("phrase") == F.col("needle"), "left_semi").select("query_id")
    each = markers.where(F.size("words") > 0).select("query_id", "phrase", F.explode("words").alias("needle"))
    spread = each.join(found.withColumn("_met", F.lit(1)), "needle", "left").groupBy("query_id", "phrase").agg(F.count_if(F.col("_met").isNull()).alias("_missing"))
    return whole.unionByName(spread.where("_missing = 0").select("query_id")).distinct()


def passes(ranks: DataFrame) -> DataFrame:
    """(mode, questions, top_10, top_1) of (mode, query_id, rank): how many questions have a good answer so high up."""
    r = F.coalesce("rank", F.lit(0))
    return ranks.groupBy("mode").agg(F.count("*").alias("questions"), F.count_if(r.between(1, 10)).alias("top_10"), F.count_if(r == 1).alias("top_1"))


def metrics(ranks: DataFrame) -> DataFrame:
    """One row of hit@1, hit@5, hit@10 and mean reciprocal rank within ten; rank is null or 0 where nothing was found."""
    r = F.coalesce("rank", F.lit(0))
    hit = lambda k: F.avg(F.when((r >= 1) & (r <= k), 1.0).otherwise(0.0)).alias(f"hit_{k}")
    return ranks.agg(F.count("*").alias("samples"), hit(1), hit(5), hit(10), F.avg(F.when((r >= 1) & (r <= 10), 1 / r).otherwise(0.0)).alias("mrr_10"))


def answers_with(words: Column, markers: Column) -> Column:
    """Whether all words of some marker are among the words; markers: array of arrays."""
    return F.exists(markers, lambda m: (F.size(m) > 0) & (F.size(F.array_except(m, words)) == 0))


def first_good(ranked: DataFrame, good: Column) -> DataFrame:
    """(query_id, rank): rank of the first good answer of every question; null without one."""
    return ranked.groupBy("query_id").agg(F.min(F.when(good, F.col("rank"))).alias("rank"))


def violations(records: DataFrame, chapters: DataFrame, books: DataFrame | None = None) -> DataFrame:
    """(rule, violations) over all records, chapters and, if given, books (with their declared counts)."""
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    text = filled("ar.matn") | filled("ar.sanad") | filled("en")
    book = ["collection", "book_number"]
    most = chapters.groupBy(*book).agg(F.max("ch").alias("_most"))
    rows = records.join(most, book, "left")

    def counted(frame: DataFrame, rules: dict[str, Column]) -> DataFrame:
        one = frame.agg(*[F.count_if(c).alias(r) for r, c in rules.items()])
        pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"`{r}`").alias("violations")) for r in rules]))
        return one.select(pairs.alias("x")).select("x.rule", "x.violations")

    found = counted(rows, {
        "no reference": ~filled("ref"), "no link": ~filled("slug"), "no number": F.col("n").isNull(), "no place in book": ~filled("inbookref"),
        "link of another collection": filled("slug") & ~F.coalesce(F.col("slug").startswith(F.concat("collection", F.lit(":"))), F.lit(False)),
        "chapter out of range": (F.col("ch") < -1) | (F.col("ch") > F.coalesce("_most", F.lit(-1))), "no text at all": ~text,
    })
    found = found.unionByName(counted(chapters, {"empty chapter": ~filled("en") & ~filled("ar")}))
    links = records.groupBy("collection", F.coalesce("slug", F.lit("")).alias("slug")).agg((F.count("*") - 1).alias("_more"))
    found = found.unionByName(links.agg(F.coalesce(F.sum("_more"), F.lit(0)).alias("violations")).select(F.lit("link of several records").alias("rule"), "violations"))
    if books is None:
        return found
    real = records.groupBy(*book).agg(F.count("*").alias("_records"))
    parts = chapters.groupBy(*book).agg(F.count("*").alias("_chapters"))
    told = books.join(real, book, "left").join(parts, book, "left").fillna(0, ["_records", "_chapters"])
    own = F.coalesce(F.col("source_file").startswith(F.concat("collection", F.lit("/"))), F.lit(False))
    return found.unionByName(counted(told, {
        "book without English name": ~filled("english"), "book without Arabic name": ~filled("arabic"), "file of another collection": ~own,
        "declared records differ": ~F.col("hadiths").eqNullSafe(F.col("_records")), "declared chapters differ": ~F.col("chapters").eqNullSafe(F.col("_chapters")),
    }))


def sequence_gaps(records: DataFrame) -> DataFrame:
    """(collection, book_number, pos, inbook, before): records whose place in the book doesn't follow the one before."""
    along = Window.partitionBy("collection", "book_number").orderBy("pos", "rec_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.last("inbook", ignorenulls=True).over(along), F.lit(0))
    rows = records.select("collection", "book_number", "pos", "inbook", before.alias("before"))
    return rows.where(F.col("inbook").isNotNull() & (F.col("inbook") != F.col("before") + 1))


def totals(records: DataFrame) -> DataFrame:
    """Per collection: records, distinct links, how many lack either side (without any text, both), have a grade, a narrator."""
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    arabic = filled("ar.matn") | filled("ar.sanad")
    return records.groupBy("collection").agg(
        F.count("*").alias("records"), F.count_distinct("slug").alias("links"), F.count_if(~filled("en")).alias("arabic_only"),
        F.count_if(~arabic).alias("english_only"), F.count_if(filled("grade") | filled("gradear")).alias("graded"),
        F.count_if(filled("narrator")).alias("narrated"),
    )
