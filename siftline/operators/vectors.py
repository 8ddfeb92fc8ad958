"""Quantised vectors: quantising, exact cosine rankings, pooling, windows of long texts, checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.operators.ranking import top

TOP = 50
#: Window of a long text in tokens, characters that surely fit, share of a step, windows at most.
WINDOW, SHORT, STEP, MOST = 512, 900, 0.8, 4


def quantize(vector: Column) -> Column:
    """struct(scale FLOAT, q ARRAY<TINYINT>): components by the largest one, rounded half up, within +-127."""
    peak = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    scale = F.when(peak > 0, peak / 127).otherwise(1.0)
    q = F.transform(vector, lambda x: F.least(F.lit(127), F.greatest(F.lit(-127), F.floor(x.cast("double") / scale + 0.5))).cast("tinyint"))
    return F.struct(scale.cast("float").alias("scale"), q.alias("q"))


def dequantize(scale: Column, q: Column) -> Column:
    return F.transform(q, lambda x: (x * scale).cast("float"))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, in the order of the components."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _best(scores: np.ndarray, docs: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The best distinct documents of one query, ties by document."""
    if len(scores) > 4 * limit:  # what is below the limit-th distinct score can't be among them
        kept = scores >= np.partition(scores, len(scores) - 4 * limit)[len(scores) - 4 * limit]
        if len(np.unique(docs[kept])) >= limit:
            scores, docs = scores[kept], docs[kept]
    order = np.lexsort((docs, -scores))
    first = np.sort(np.unique(docs[order], return_index=True)[1])[:limit]
    return scores[order][first], docs[order][first]


def similar(queries: DataFrame, vectors: DataFrame, limit: int = TOP, block: int = 512, sent: int = 64 << 20) -> DataFrame:
    """(query_id, doc_id, score, rank): exact ranking of documents by the best of their vectors.

    queries (query_id, vector) are stated: they are sent out, at most `sent` bytes at once, and multiplied in blocks with
    the vectors where these lie; so many bytes of queries cost one scan of the vectors. A task hands on its own best
    documents per query only. vectors: (doc_id, scale, q). Vectors of other lengths are left out. Scores are single
    precision, so equal ones are ordered by document.
    """
    spark = vectors.sparkSession
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id bigint, score float"
    parts: list[DataFrame] = []

    def scored(shared) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, matrix = shared.value
            held = [(np.zeros(0, np.float32), np.zeros(0, np.int64))] * len(ids)
            for batch in batches:
                fit = np.array([q is not None and len(q) == matrix.shape[1] for q in batch["q"]], bool)
                rows = batch[fit]
                if not len(rows):
                    continue
                data = np.vstack(rows["q"].tolist()).astype(np.float64)
                scale, docs = rows["scale"].to_numpy(np.float64), rows["doc_id"].to_numpy(np.int64)
                for at in range(0, len(ids), block):
                    scores = ((data @ matrix[at : at + block].T) * scale[:, None]).astype(np.float32).T
                    for k, own in enumerate(scores):
                        old, known = held[at + k]
                        new, met = _best(own, docs, limit)
                        held[at + k] = _best(np.r_[old, new], np.r_[known, met], limit) if len(old) else (new, met)
            sizes = [len(s) for s, _ in held]
            yield pd.DataFrame({
                "query_id": np.repeat(ids, sizes), "doc_id": np.concatenate([d for _, d in held]) if held else [],
                "score": np.concatenate([s for s, _ in held]) if held else [],
            })

        return run

    def send(rows: list) -> None:
        ids = np.array([r.query_id for r in rows])
        matrix = np.array([r.vector for r in rows], np.float64)
        parts.append(vectors.select("doc_id", "scale", "q").mapInPandas(scored(spark.sparkContext.broadcast((ids, matrix))), schema))

    waiting: list = []
    for row in queries.select("query_id", "vector").orderBy("query_id").toLocalIterator():
        waiting.append(row)
        if len(waiting) * len(row.vector) * 8 >= sent:
            send(waiting)
            waiting = []
    if waiting:
        send(waiting)
    if not parts:
        return spark.createDataFrame([], schema + ", rank int")
    best = parts[0]
    for more in parts[1:]:
        best = best.unionByName(more)
    return top(best.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), limit)


def windows(text: Column, kind: str, tokens: Column, words: Column) -> Column:
    """Overlapping windows of a long text with its prefix; tokens is the prefixed text's length in the encoder's tokens."""
    head = F.concat(F.lit(f"{kind}: "))
    whole = F.array(F.concat(head, text))
    pieces = F.greatest(F.lit(2), F.ceil(tokens / (WINDOW - 24)))
    n = F.size(words)
    size = F.ceil(n / pieces).cast("int")
    step = F.greatest(F.lit(1), F.floor(size * STEP + 0.5).cast("int"))
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), step), lambda s: (s == 0) | (s - step + size < n))
    parts = F.transform(F.slice(starts, 1, MOST), lambda s: F.concat(head, F.array_join(F.slice(words, s + 1, size), " ")))
    return F.when((F.length(text) + len(f"{kind}: ") <= SHORT) | (tokens <= WINDOW) | (n == 0), whole).otherwise(parts)


def encode(texts: DataFrame, key: str, field: str, encoder: Callable[[list[str]], np.ndarray], batch: int = 32) -> DataFrame:
    """(key, vector): a pluggable encoder over batches of texts of similar length."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows = rows.iloc[np.argsort(rows["_text"].str.len().to_numpy(), kind="stable")]
            for at in range(0, len(rows), batch):
                some = rows.iloc[at : at + batch]
                yield pd.DataFrame({"_key": some["_key"], "vector": list(np.asarray(encoder(some["_text"].tolist()), np.float32))})

    source = texts.select(F.col(key).alias("_key"), F.coalesce(F.col(field), F.lit("")).alias("_text"))
    return source.mapInPandas(run, f"_key {kind}, vector array<float>").withColumnRenamed("_key", key)


def hashing_encoder(dims: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for tests: unit vectors of hashed words. It knows no meaning."""

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), np.float32)
        for i, text in enumerate(texts):
            words = text.split()
            if words:
                h = pd.util.hash_array(np.array(words, object), categorize=False)
                np.add.at(out[i], (h % np.uint64(dims)).astype(int), np.where(h >> np.uint64(63), 1.0, -1.0))
            size = np.linalg.norm(out[i])
            out[i] /= size or 1
        return out

    return run


def mean_pool(tokens: DataFrame, hold: int = 10_000) -> DataFrame:
    """(text_id, vector) of token rows (text_id, mask, vector): the mean over mask = 1, at unit length; zero stays zero.

    A task adds up the vectors of a text before anything travels, for so many texts at a time."""
    kind = tokens.schema["text_id"].dataType.simpleString()

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}

        def out() -> pd.DataFrame:
            return pd.DataFrame({"text_id": list(sums), "n": [n for n, _ in sums.values()], "vector": [v for _, v in sums.values()]})

        for batch in batches:
            for key, vector in zip(batch["text_id"].tolist(), batch["vector"]):
                n, total = sums.get(key, (0, 0.0))
                sums[key] = n + 1, total + np.asarray(vector, np.float64)
            if len(sums) > hold:
                yield out()
                sums = {}
        if sums:
            yield out()

    parts = tokens.where("mask = 1").select("text_id", "vector").mapInPandas(added, f"text_id {kind}, n bigint, vector array<double>")
    each = parts.select("text_id", "n", F.posexplode("vector").alias("d", "x"))
    means = each.groupBy("text_id", "d").agg((F.sum("x") / F.sum("n")).alias("m"))
    pooled = means.groupBy("text_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda p: p["m"]).alias("v"))
    size = norm(F.col("v"))
    return pooled.withColumn("n", F.when(size > 0, size).otherwise(1.0)).select("text_id", F.transform("v", lambda x: (x / F.col("n")).cast("float")).alias("vector"))


def agreement(documents: DataFrame, embedded: DataFrame) -> DataFrame:
    """One row on two indexes over doc_id: documents of either, those that only one has, and whether they agree."""
    a = documents.where("doc_id is not null").select("doc_id", F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = embedded.where("doc_id is not null").select("doc_id", F.lit(0).alias("a"), F.lit(1).alias("b"))
    each = a.unionByName(b).groupBy("doc_id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    one = each.agg(
        F.count_if(F.col("a") == 1).alias("documents"), F.count_if(F.col("b") == 1).alias("with_vectors"),
        F.count_if(F.col("b") == 0).alias("words_only"), F.count_if(F.col("a") == 0).alias("vectors_only"),
    )
    return one.withColumn("agree", (F.col("words_only") == 0) & (F.col("vectors_only") == 0))


def checks(vectors: DataFrame, dims: Column | int, tolerance: float = 0.01) -> DataFrame:
    """One row over all vectors: how many, of another length, empty, and not of unit length."""
    length = norm(F.transform("q", lambda x: x * F.col("scale")))
    fits = F.col("q").isNotNull() & (F.size("q") == F.lit(dims))
    return vectors.agg(
        F.count("*").alias("vectors"), F.count_if(F.col("q").isNull()).alias("empty"),
        F.count_if(F.col("q").isNotNull() & ~fits).alias("other_length"), F.count_if(fits & (F.abs(length - 1) > tolerance)).alias("not_unit"),
    )
