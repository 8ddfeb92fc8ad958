"""The query API: a batch of questions in, ranked, explained and hydrated records out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import display, words
from siftline.operators import browse, lexical, ranking, vectors
from siftline.session import cut

SHORTEST_QUESTION = 3


@dataclass
class Outcome:
    """Results of a batch of questions, and one row per question on how they were found."""

    results: DataFrame
    summary: DataFrame
    semantic_failed: bool = False


@dataclass
class Engine:
    """Ranks records for questions by words and, with vectors and an encoder, by meaning.

    records and chapters are the domain tables with one row per record; vectors has (doc_id, scale, q). The index
    relations are made at the first question and kept in the shared folder. encoder maps texts to unit vectors; without
    it, or when it fails, results come from words alone and the outcome says so.
    """

    spark: SparkSession
    records: DataFrame
    chapters: DataFrame
    books: DataFrame
    vectors: DataFrame | None = None
    encoder: Callable[[list[str]], np.ndarray] | None = None
    cutoff: float = lexical.CUTOFF
    on_semantic_error: Callable[[Exception], None] | None = None
    _index: dict = field(default_factory=dict)

    def index(self) -> dict:
        """Postings, lengths, vocabulary and corpus figures, written once."""
        if not self._index:
            posted = cut(lexical.postings(lexical.document_text(self.records, self.chapters), lengths=True))
            ids = self.records.select(F.col("rec_id").alias("doc_id"))
            lengths = cut(lexical.doc_lengths(ids, posted.select("doc_id", "tf")))
            row = lengths.agg(F.count("*").alias("n"), F.coalesce(F.floor(F.avg("doc_len") + 0.5), F.lit(0)).alias("a")).first()
            kept = cut(lexical.vocabulary(posted, row.n, self.cutoff))
            self._index = {"postings": posted, "lengths": lengths, "vocabulary": kept, "total": row.n, "average": row.a}
        return self._index

    @staticmethod
    def valid(questions: DataFrame) -> DataFrame:
        """Questions of three or more characters."""
        return questions.where(F.length(words.trim(F.col("text"))) >= SHORTEST_QUESTION)

    def parts(self, questions: DataFrame) -> DataFrame:
        """What every word of every question adds to every record: the explanation of a score."""
        i = self.index()
        return ranking.contributions(lexical.query_terms(questions), i["postings"], i["lengths"], i["vocabulary"], i["total"], i["average"])

    def lexical(self, questions: DataFrame, pool: int = ranking.POOL) -> DataFrame:
        i = self.index()
        return ranking.ranked(lexical.query_terms(questions), i["postings"], i["vocabulary"], i["total"], i["average"], pool)

    def semantic(self, questions: DataFrame, pool: int = ranking.POOL) -> DataFrame:
        """Records by the best of their vectors; empty without vectors or an encoder."""
        if self.vectors is None or self.encoder is None:
            kind = questions.schema["query_id"].dataType.simpleString()
            return self.spark.createDataFrame([], f"query_id {kind}, doc_id bigint, score float, rank int")
        asked = questions.select("query_id", F.concat(F.lit("query: "), "text").alias("text"))
        return vectors.similar(vectors.encode(asked, "query_id", "text", self.encoder), self.vectors, pool)

    def search(
        self, questions: DataFrame, limit: int = 20, pool: int = ranking.POOL, semantic: bool = True, lexical_weight: float = 1.0, vector_weight: float = 1.0,
    ) -> Outcome:
        """Fused ranking of every question with highlight terms."""
        questions, failed = self.valid(questions), False
        by_words = cut(self.lexical(questions, pool))
        by_meaning = self.semantic(questions.limit(0), pool)
        if semantic:
            try:
                by_meaning = cut(self.semantic(questions, pool))
            except Exception as error:  # whatever the encoder throws: words still answer
                failed = self.vectors is not None and self.encoder is not None
                if self.on_semantic_error:
                    self.on_semantic_error(error)
        fused = cut(ranking.fuse(by_words, by_meaning, limit, lexical_weight, vector_weight))
        i = self.index()
        found = fused.join(ranking.highlight_terms(fused, i["vocabulary"], i["total"]), ["query_id", "doc_id"])
        return Outcome(found, ranking.summary(questions, fused, by_words, by_meaning), failed)

    def ask(self, questions: DataFrame, limit: int = 15, site: str = "", **options) -> Outcome:
        """search() with each result's record, book, chapter, link, and why it matched; the first result is the answer."""
        outcome = self.search(questions, limit, **options)
        ids = outcome.results.select(F.col("doc_id").alias("rec_id")).distinct()
        rows = ranking.hydrate(outcome.results, self.records.join(ids, "rec_id", "left_semi"), self.books, self.chapters, site)
        why = outcome.results.select(
            "query_id", F.col("doc_id").alias("rec_id"), "highlight", display.why(F.col("lexical_rank"), F.col("vector_rank"), F.col("terms")).alias("why")
        )
        rows = rows.join(why, ["query_id", "rec_id"]).withColumn("answer", F.col("rank") == 1)
        return Outcome(rows, outcome.summary, outcome.semantic_failed)

    def record(self, doc_id: int) -> DataFrame:
        return self.records.where(F.col("rec_id") == doc_id)

    def by_link(self, link: str) -> DataFrame:
        return self.records.where(F.col("slug") == link)

    def read(self, collection: str, book: int, chapter: int | None = None, size: int = browse.PAGE) -> DataFrame:
        """A book's records with headings, from a chapter's first record on."""
        own = self.records.where((F.col("collection") == collection) & (F.col("book_number") == book))
        start = 0
        if chapter is not None:
            start = own.where(F.col("ch") == chapter).agg(F.coalesce(F.min("pos"), F.lit(0))).first()[0]
        return browse.page(browse.headed(own, self.chapters), collection, book, start, size)

    def topics(self, needle: str = "") -> DataFrame:
        keyed = browse.keyed_topics(browse.topics(self.chapters, self.records), self.books)
        return browse.filter_topics(keyed, needle)
