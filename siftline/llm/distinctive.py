"""Problem 1: how distinctive a term is of a record (log-entropy weighting)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions.words import WordReader
from siftline.session import cut


@F.pandas_udf(T.ArrayType(T.StringType()))
def _words(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    reader = WordReader()
    for batch in texts:
        yield pd.Series([reader.words(text) for text in batch], dtype=object)


def words_of(*fields: str) -> Column:
    """The words of all fields. Taken before rows are exchanged by their key, they leave records where these then lie."""
    return _words(F.concat_ws(" ", *[F.col(f) for f in fields]))


def log_entropy(records: DataFrame, key: str, *fields: str) -> DataFrame:
    """(key, term, tf, df, gf, score) of every term of every record; fields: texts, or one column of words (see words_of).

    score = ln(1 + tf) * (1 - H / ln N) with H the entropy of the term's spread over the N records: a term spread
    evenly over all records gets 0, a term of one record the whole local weight.

    Two aggregations: (record, term) -> tf, which needs no exchange of its own when the records come partitioned by
    their key, and term -> (gf, df, sum of tf ln tf), combined before its exchange. Texts are read once: the counts are
    written to the shared folder, from which both aggregation and join take them. Only the term statistics meet the
    counts again, in a join in which a term has at most one row per record; AQE splits the partitions of terms that are
    in most records.

    Null and empty fields hold nothing; a record without words gives no row; an empty input gives an empty result.
    Null words are none. With one record every H is 0. records must have one row per key; columns may bear any names.
    """
    ready = len(fields) == 1 and isinstance(records.schema[fields[0]].dataType, T.ArrayType)
    words = F.col(fields[0]) if ready else words_of(*fields)
    terms = records.select(F.col(key).alias("_key"), F.explode(words).alias("term"))
    counts = cut(terms.groupBy("_key", "term").agg(F.count("*").alias("tf")))
    stats = counts.groupBy("term").agg(
        F.sum("tf").alias("gf"), F.count("*").alias("df"), F.sum(F.col("tf") * F.log("tf")).alias("_tlt")
    )
    total = records.agg(F.count("*").alias("n")).scalar()
    entropy = F.log("gf") - F.col("_tlt") / F.col("gf")
    spread = F.when(total > 1, entropy / F.log(total)).otherwise(0.0)
    return counts.join(stats, "term").select(
        F.col("_key").alias(key), "term", "tf", "df", "gf", (F.log1p("tf") * (1 - spread)).alias("score")
    )
