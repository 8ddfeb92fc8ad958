"""The word index as tables: postings, document lengths, vocabulary, corpus figures; and questions as term groups."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import words as W

#: Share of the documents above which a term is left out of the vocabulary.
CUTOFF = 0.2
#: Rows of a batch that a worker hands on.
ROWS = 200_000
#: What the searchable text of a record is made of.
FIELDS = ("collection", "book_number", "ch", "ar", "en", "narrator")


def document_text(records: DataFrame, chapters: DataFrame, key: str = "rec_id") -> DataFrame:
    """(doc_id, text): the searchable text of every record with its chapter's titles; empty parts are left out."""
    titles = chapters.select(
        "collection", "book_number", F.col("ch"), F.col("ar").alias("_ch_ar"), F.col("en").alias("_ch_en")
    )
    joined = records.where(F.col("ch") >= 0).join(titles, ["collection", "book_number", "ch"], "left").unionByName(
        records.where(F.coalesce(F.col("ch"), F.lit(-1)) < 0), allowMissingColumns=True
    )
    parts = F.array("ar.matn", "ar.sanad", "en", "narrator", "_ch_ar", "_ch_en")
    return joined.select(F.col(key).alias("doc_id"), F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), "\n").alias("text"))


def postings(docs: DataFrame, lengths: bool = False) -> DataFrame:
    """(term, doc_id, tf): index terms of every document: words and their variants, without stopwords; with lengths, also
    doc_len, so that no score has to look it up.

    A document is one row, so its terms are counted where it lies and no exchange is needed. It is done on Arrow batches:
    a piece of text is normalised and expanded once per worker, not once per occurrence as an expression would do, which
    took about fifty times as long.
    """
    names = ["term", "doc_id", "tf", *(["doc_len"] if lengths else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = W.TermReader()

        def out() -> pa.RecordBatch:
            columns = [pa.array(terms, pa.string()), pa.array(ids, pa.int64()), pa.array(tfs, pa.int64()), pa.array(sizes, pa.int64())]
            return pa.RecordBatch.from_arrays(columns[: len(names)], names=names)

        for batch in batches:
            terms, ids, tfs, sizes = [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = reader.counts(text)
                terms.extend(own)
                ids.extend([key] * len(own))
                tfs.extend(own.values())
                sizes.extend([sum(own.values())] * len(own))
                if len(terms) > ROWS:
                    yield out()
                    terms, ids, tfs, sizes = [], [], [], []
            yield out()

    schema = "term string, doc_id bigint, tf bigint" + (", doc_len bigint" if lengths else "")
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)


def first_places(docs: DataFrame) -> DataFrame:
    """(term, doc_id, place): index terms of every document in the order in which they first come up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = W.TermReader()
        for batch in batches:
            rows = [(t, key, i) for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, t in enumerate(reader.counts(text))]
            terms, ids, at = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(ids, pa.int64()), pa.array(at, pa.int32())], names=["term", "doc_id", "place"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "term string, doc_id bigint, place int")


def doc_lengths(docs: DataFrame, posted: DataFrame) -> DataFrame:
    """(doc_id, doc_len) of every document; lengths count all terms, also those the vocabulary drops."""
    sums = posted.groupBy("doc_id").agg(F.sum("tf").alias("doc_len"))
    return docs.select("doc_id").join(sums, "doc_id", "left").select("doc_id", F.coalesce("doc_len", F.lit(0)).alias("doc_len"))


def frequencies(posted: DataFrame) -> DataFrame:
    """(term, df)."""
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def vocabulary(posted: DataFrame, total: Column | int, cutoff: float = CUTOFF) -> DataFrame:
    """(term, df) of terms in at most floor(cutoff * total) documents."""
    return frequencies(posted).where(F.col("df") <= F.floor(F.lit(cutoff) * F.lit(total)))


def corpus_figures(docs: DataFrame, posted: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """One row: documents, rounded mean length, kept and dropped terms, kept postings. posted is read twice: hand on a
    written table."""
    total = docs.agg(F.count("*")).scalar()
    length = posted.agg(F.coalesce(F.sum("tf"), F.lit(0))).scalar()
    count = F.lit(total)
    kept = F.col("df") <= F.floor(F.lit(cutoff) * count)
    return frequencies(posted).agg(
        F.max(count).alias("_n"), F.count_if(kept).alias("term_count"), F.count_if(~kept).alias("dropped_terms"),
        F.coalesce(F.sum(F.when(kept, F.col("df"))), F.lit(0)).alias("postings"),
    ).select(count.alias("doc_count"), F.when(count > 0, F.floor(F.lit(length) / count + 0.5)).alias("avg_doc_len"), "term_count", "dropped_terms", "postings")


def query_terms(questions: DataFrame, key: str = "query_id", field: str = "text") -> DataFrame:
    """(query_id, grp, pos, term, weight): every word of a question is a group of its spellings.

    Repeated words count once. Groups with a stopword among their spellings are dropped, unless that drops all groups of
    a question. weight is 1 / spellings; scores don't use it. A question is one row and is taken apart where it lies.
    """
    kind = questions.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stop = frozenset(W.STOPWORDS)
        for batch in batches:
            rows = []
            for own, text in zip(batch["_key"].tolist(), batch["_text"]):
                groups: dict[str, list[str]] = {}
                for raw in W.py_split(text):
                    word = W.py_normalize(raw)
                    if len(word) >= W.MIN_LENGTH and word not in groups:
                        groups[word] = list(dict.fromkeys([word, *[v for v in W.py_variants(raw, word) if len(v) >= W.MIN_LENGTH]]))
                real = [g for g in groups.values() if not stop.intersection(g)] or list(groups.values())
                rows += [(own, g, p, t, 1 / len(spelt)) for g, spelt in enumerate(real) for p, t in enumerate(spelt)]
            yield pd.DataFrame(rows, columns=["query_id", "grp", "pos", "term", "weight"])

    source = questions.select(F.col(key).alias("_key"), F.col(field).alias("_text"))
    return source.mapInPandas(run, f"query_id {kind}, grp int, pos int, term string, weight double")


def plain_terms(questions: DataFrame, key: str = "query_id", field: str = "terms") -> DataFrame:
    """(query_id, grp, pos, term, weight) of questions given as arrays of terms: each its own group, repeats once."""
    each = questions.select(F.col(key).alias("query_id"), F.posexplode(F.array_distinct(field)).alias("grp", "term"))
    return each.select("query_id", "grp", F.lit(0).alias("pos"), "term", F.lit(1.0).alias("weight"))
