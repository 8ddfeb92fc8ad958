"""Ranking: BM25 over term groups, reciprocal-rank fusion, confidence, highlight terms, explanation, hydration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import words

K1, B = 1.2, 0.75
#: Constant of the fusion, candidates of each ranking, and share of documents above which a term isn't highlighted.
RRF, POOL, TOO_COMMON = 60, 60, 0.15


#: A frequency and a place packed in one number, so that the best of a group is a plain maximum; scores as fixed point.
_PLACES, _POINT = 1 << 20, float(1 << 40)


def scores(terms: DataFrame, posted: DataFrame, vocabulary: DataFrame, total: Column, average: Column, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, grp, pos, tf, idf, score): what every group adds to every document it meets; pos is the place
    of the spelling it meets with. posted has (term, doc_id, tf, doc_len).

    One exchange, by (query_id, doc_id), serves the best spelling of a group and everything that sums up a document. posted
    is never broadcast: Spark goes by the size of its compressed files, a small part of what its rows take."""
    total, average = F.lit(total), F.lit(average)
    idf = F.log(1 + (total - F.col("df") + 0.5) / (F.col("df") + 0.5))
    own = Window.partitionBy("query_id", "grp")
    worth = F.coalesce(F.min(F.when(F.length("term") >= 3, idf)).over(own), F.min(idf).over(own))
    known = terms.join(vocabulary, "term").select("query_id", "grp", "pos", "term", worth.alias("idf"))
    met = known.join(posted.hint("merge"), "term").select(
        "query_id", "doc_id", "grp", (F.col("tf") * _PLACES + (_PLACES - 1 - F.col("pos"))).alias("_packed"), "idf", "doc_len"
    )
    best = met.repartition("query_id", "doc_id").groupBy("query_id", "doc_id", "grp").agg(F.max("_packed").alias("_m"), F.max("idf").alias("idf"), F.max("doc_len").alias("doc_len"))
    size = F.when(F.col("doc_len") == 0, 1).otherwise(F.col("doc_len")) / F.when(average == 0, 1).otherwise(average)
    tf = F.shiftright("_m", 20)
    score = F.col("idf") * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * size))
    place = (_PLACES - 1 - F.col("_m").bitwiseAND(_PLACES - 1)).cast("int")
    return best.select("query_id", "doc_id", "grp", place.alias("pos"), tf.alias("tf"), "idf", score.alias("score"))


def contributions(
    terms: DataFrame, posted: DataFrame, lengths: DataFrame | None, vocabulary: DataFrame, total: Column, average: Column, k1: float = K1, b: float = B,
) -> DataFrame:
    """(query_id, doc_id, grp, via, tf, idf, score): what every group adds to every document it meets.

    A group is worth the idf of its most common spelling of three or more characters (of any, if it has no such), and
    meets a document with its most frequent spelling there, the first one of equally frequent ones. lengths may be left
    out where posted has the documents' lengths.
    """
    if "doc_len" not in posted.columns:
        posted = posted.join(lengths, "doc_id")
    named = terms.select("query_id", "grp", "pos", F.col("term").alias("via"))
    parts = scores(terms, posted, vocabulary, total, average, k1, b).join(named, ["query_id", "grp", "pos"])
    return parts.select("query_id", "doc_id", "grp", "via", "tf", "idf", "score")


def ranked(
    terms: DataFrame, posted: DataFrame, vocabulary: DataFrame, total: Column, average: Column, limit: int = POOL, k1: float = K1, b: float = B,
) -> DataFrame:
    """bm25() of contributions(), for many questions at once: only numbers are summed up (as fixed point, so in any
    order), and the words that met are looked up for the best documents alone."""
    parts = scores(terms, posted, vocabulary, total, average, k1, b)
    hits = parts.groupBy("query_id", "doc_id").agg((F.sum(F.round(F.col("score") * _POINT).cast("bigint")) / _POINT).alias("score"))
    best = top(hits, limit)
    named = terms.select("query_id", "grp", "pos", "term")
    met = parts.select("query_id", "doc_id", "grp", "pos").join(best.select("query_id", "doc_id"), ["query_id", "doc_id"]).join(named, ["query_id", "grp", "pos"])
    listed = F.array_sort(F.collect_list(F.struct("grp", "term")))
    words = met.groupBy("query_id", "doc_id").agg(F.transform(listed, lambda x: x["term"]).alias("terms"))
    return best.join(words, ["query_id", "doc_id"]).select("query_id", "doc_id", "score", "terms", "rank")


def places(wanted: DataFrame, hits: DataFrame, above: int = 3) -> DataFrame:
    """(query_id, doc_id, rank, of, above) for stated pairs (query_id, doc_id): the document's rank among all hits of
    its question (0 if it isn't among them), how many there are, and the documents right above it, best first.

    hits (query_id, doc_id, score) need no order: better hits are counted, and only those are ranked that stand above.
    """
    own = wanted.select("query_id", F.col("doc_id").alias("_doc")).distinct()
    mine = own.join(hits.select("query_id", F.col("doc_id").alias("_doc"), F.col("score").alias("_score")), ["query_id", "_doc"], "left")
    met = mine.join(hits, "query_id", "left")
    better = (F.col("score") > F.col("_score")) | ((F.col("score") == F.col("_score")) & (F.col("doc_id") < F.col("_doc")))
    counted = met.groupBy("query_id", "_doc").agg(
        F.count("doc_id").alias("of"), F.when(F.max("_score").isNull(), 0).otherwise(F.count_if(better) + 1).alias("rank")
    )
    near = Window.partitionBy("query_id", "_doc").orderBy("score", F.desc("doc_id"))
    next_up = met.where(better).withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= above)
    listed = next_up.groupBy("query_id", "_doc").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), "doc_id"))), lambda x: x["doc_id"]).alias("above"))
    rows = counted.join(listed, ["query_id", "_doc"], "left")
    return rows.select("query_id", F.col("_doc").alias("doc_id"), "rank", "of", F.coalesce("above", F.array().cast("array<bigint>")).alias("above"))


def sources(parts: DataFrame, terms: DataFrame, vocabulary: DataFrame, texts: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, doc_id, grp, words): the words of a document's text (doc_id, text) whose spellings met a group, by
    spelling and then by place, the first few. Documents and groups are those of parts."""
    pairs = parts.select("query_id", "doc_id").distinct()
    raw = pairs.join(texts, "doc_id").select("query_id", "doc_id", F.posexplode(words.split_words(F.col("text"))).alias("_at", "_raw"))
    first = raw.groupBy("query_id", "doc_id", "_raw").agg(F.min("_at").alias("_at"))
    made = first.withColumn("_word", words.normalize(F.col("_raw"))).where(F.length("_word") > 0)
    spelt = made.select("query_id", "doc_id", "_at", "_raw", F.explode(words.variants(F.col("_raw"), F.col("_word"))).alias("term"))
    known = terms.join(vocabulary.select("term"), "term").select("query_id", "grp", "pos", "term")
    met = spelt.join(known, ["query_id", "term"]).groupBy("query_id", "doc_id", "grp", "_raw").agg(F.min(F.struct("pos", "_at")).alias("_p"))
    listed = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_raw"))), lambda x: x["_raw"]), 1, most)
    return met.groupBy("query_id", "doc_id", "grp").agg(listed.alias("words"))


def bm25(parts: DataFrame, limit: int = POOL) -> DataFrame:
    """(query_id, doc_id, score, terms, rank): the best documents of every question; equal scores by smaller id.

    Scores add up in the order of the groups, whatever order the rows come in.
    """
    ordered = F.array_sort(F.collect_list(F.struct("grp", "score", "via")))
    hits = parts.groupBy("query_id", "doc_id").agg(ordered.alias("g")).select(
        "query_id", "doc_id", F.aggregate("g", F.lit(0.0), lambda acc, x: acc + x["score"]).alias("score"),
        F.transform("g", lambda x: x["via"]).alias("terms"),
    )
    return top(hits, limit)


def top(hits: DataFrame, limit: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


def fuse(lexical: DataFrame, similar: DataFrame, limit: int = 20, lexical_weight: float = 1.0, vector_weight: float = 1.0) -> DataFrame:
    """(query_id, doc_id, score, lexical_rank, vector_rank, vector_score, terms, rank) by reciprocal ranks.

    A document missing from a ranking has rank 0 there. One exchange: both rankings are appended and grouped.
    """
    none = F.lit(None)
    a = lexical.select("query_id", "doc_id", F.col("rank").alias("l"), none.cast("int").alias("v"), none.cast("double").alias("s"), "terms")
    b = similar.select("query_id", "doc_id", none.cast("int").alias("l"), F.col("rank").alias("v"), F.col("score").cast("double").alias("s"), none.cast("array<string>").alias("terms"))
    both = a.unionByName(b).groupBy("query_id", "doc_id").agg(F.max("l").alias("l"), F.max("v").alias("v"), F.max("s").alias("vector_score"), F.max("terms").alias("terms"))
    part = lambda rank, weight: F.coalesce(F.lit(weight) / (RRF + F.col(rank)), F.lit(0.0))
    scored = both.select(
        "query_id", "doc_id", (part("l", lexical_weight) + part("v", vector_weight)).alias("score"),
        F.coalesce("l", F.lit(0)).alias("lexical_rank"), F.coalesce("v", F.lit(0)).alias("vector_rank"),
        "vector_score", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"),
    )
    return top(scored, limit)


def confidence(lexical_rank: Column, vector_rank: Column) -> Column:
    both = (lexical_rank > 0) & (vector_rank > 0)
    return (
        F.when(lexical_rank.isNull(), "none")
        .when(both & (lexical_rank <= 3) & (vector_rank <= 3), "strong")
        .when(both, "good")
        .when((lexical_rank > 0) & (lexical_rank <= 3), "fair")
        .when((vector_rank > 0) & (vector_rank <= 3), "fair")
        .otherwise("weak")
    )


def summary(questions: DataFrame, fused: DataFrame, lexical: DataFrame, similar: DataFrame) -> DataFrame:
    """One row per question, also for one without results: confidence of its first result, sizes of both rankings."""
    first = fused.where("rank = 1").select("query_id", "lexical_rank", "vector_rank")
    count = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    rows = questions.select("query_id").join(first, "query_id", "left")
    rows = rows.join(count(lexical, "lexical_count"), "query_id", "left").join(count(similar, "semantic_count"), "query_id", "left")
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return rows.select(
        "query_id", confidence(F.col("lexical_rank"), F.col("vector_rank")).alias("confidence"), zero("lexical_count"), zero("semantic_count")
    )


def highlight_terms(fused: DataFrame, vocabulary: DataFrame, total: Column, most: int = 6) -> DataFrame:
    """(query_id, doc_id, highlight): the rarest terms that found a document, without those in too many documents."""
    each = fused.select("query_id", "doc_id", F.posexplode("terms").alias("at", "term"))
    once = each.groupBy("query_id", "doc_id", "term").agg(F.min("at").alias("at"))
    rare = once.join(vocabulary, "term").where(F.col("df") <= F.floor(F.lit(total) * TOO_COMMON + 0.5))
    ordered = F.array_sort(F.collect_list(F.struct("df", "at", "term")))
    found = rare.groupBy("query_id", "doc_id").agg(F.slice(F.transform(ordered, lambda x: x["term"]), 1, most).alias("highlight"))
    rows = fused.select("query_id", "doc_id").join(found, ["query_id", "doc_id"], "left")
    return rows.select("query_id", "doc_id", F.coalesce("highlight", F.array().cast("array<string>")).alias("highlight"))


def hydrate(fused: DataFrame, records: DataFrame, books: DataFrame, chapters: DataFrame, site: str = "", key: str = "rec_id") -> DataFrame:
    """Fused results with their record, book and chapter; results without a record are dropped. Texts join last."""
    got = fused.select("query_id", F.col("doc_id").alias(key), "rank", "score").join(records, key)  # records of few ids: see records_of
    got = got.join(books.select("collection", "book_number", F.col("english").alias("book")), ["collection", "book_number"], "left")
    titles = chapters.select("collection", "book_number", "ch", F.col("en").alias("chapter"))
    got = got.join(titles, ["collection", "book_number", "ch"], "left")
    url = F.when(F.coalesce("slug", F.lit("")) != "", F.concat(F.lit(site), "slug"))
    return got.withColumn("url", url)
