"""Problem 6: the most similar vectors of every vector (permutation index: pivots, footrule as a filter, scan by cosine)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.session import cut, parallelism

K = 10
#: Pivots: so many times the square root of the number of vectors, within these bounds; the largest set has 65,536 x dims.
PIVOTS, FEWEST_PIVOTS, MOST_PIVOTS = 1.5, 32, 65_536
#: Nearest pivots a vector is represented by, of those the ones in whose inverted files it is posted, and the ones
#: whose files a query looks into. Measured on 91,000 vectors: recall of the ten nearest 0.94.
ORDERED, POSTED, VISITED = 10, 2, 10
#: Vectors that one block of an inverted file holds; longer files have several blocks, each of which is looked into.
BLOCK = 4_096
#: Least accumulated rank weight of a candidate (of ORDERED * (ORDERED + 1) / 2); what has less isn't reranked.
LEAST_WEIGHT = 9
#: Candidates beyond k that single precision keeps for the exact cosines to decide.
SPARE = 6


def usable(vectors: DataFrame, dims, key: str = "vec_id", scale: str = "scale", field: str = "q") -> DataFrame:
    """(_id, _q): one row per key of vectors with dims components, not all zero; _q holds the signed bytes.

    A negative scale turns the signs; a zero or null scale makes the vector zero, so it isn't usable. Cosines don't
    depend on the scale otherwise. Of rows with one key the greatest counts (repeated rows are equal).
    """
    signed = F.when(F.col(scale) < 0, F.transform(field, lambda x: (-x).cast("smallint"))).otherwise(F.col(field).cast("array<smallint>"))
    fit = (F.size(field) == dims) & F.exists(field, lambda x: x != 0) & ~F.exists(field, lambda x: x.isNull())
    rows = vectors.where(F.col(key).isNotNull() & F.col(field).isNotNull() & (F.col(scale) != 0) & fit)
    return rows.groupBy(F.col(key).alias("_id")).agg(F.max(signed).alias("_q"))


def _matrix(column: pd.Series) -> np.ndarray:
    rows = np.vstack([np.frombuffer(x, np.int16) for x in column]).astype(np.float32)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"_id": batch["_id"], "_q": [np.asarray(q, np.int16).tobytes() for q in batch["_q"]]})


def _permuted(shared, ordered: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivots = shared.value
        n = min(ordered, len(pivots))
        for batch in batches:
            if not len(batch):
                continue
            near = _matrix(batch["_q"]) @ pivots.T
            top = np.argpartition(-near, n - 1, axis=1)[:, :n]
            order = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)
            yield pd.DataFrame({"_id": batch["_id"], "_q": batch["_q"], "_near": list(order.astype(np.int32))})

    return run


def _posted(perms: np.ndarray, ordered: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """pivot -> (rows that have it among their nearest, rank weights)."""
    n, width = perms.shape
    order = np.argsort(perms, axis=None, kind="stable")
    pivots = perms.ravel()[order]
    rows, weights = np.repeat(np.arange(n), width)[order], np.tile(np.arange(ordered, ordered - width, -1, dtype=np.int16), n)[order]
    edges = [0, *(np.flatnonzero(np.diff(pivots)) + 1).tolist(), len(pivots)]
    return {int(pivots[i]): (rows[i:j], weights[i:j]) for i, j in zip(edges, edges[1:]) if i < j}


def _weights(perms: np.ndarray, posted: dict[int, tuple[np.ndarray, np.ndarray]], size: int, ordered: int) -> np.ndarray:
    """Sum over shared pivots of the lesser rank weight: the footrule distance is constant - 2 * this."""
    total = np.zeros((len(perms), size), np.int16)
    for pivot, (rows, weight) in _posted(perms, ordered).items():
        if pivot in posted:
            at, own = posted[pivot]
            total[rows[:, None], at] += np.minimum(weight[:, None], own)
    return total


def _ranked(k: int, ordered: int, least: int):
    """Rows come sorted by (cell, block), the block's vectors before its queries; queries stream."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, ids, posted, matrix = None, [], None, {}, None
        for batch in batches:
            out: list[pd.DataFrame] = []
            runs = (batch["_cell"].to_numpy(np.int64) << 32) + (batch["_block"].to_numpy(np.int64) << 1) + batch["_kind"].to_numpy(np.int64)
            edges = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), len(runs)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                part, where = batch.iloc[a:b], int(runs[a]) >> 1
                if where != at:
                    at, held, matrix = where, [], None
                if not runs[a] & 1:
                    held.append(part)
                    continue
                if matrix is None:
                    if not held:
                        continue
                    block = pd.concat(held)
                    ids, matrix = block["_id"].to_numpy(), _matrix(block["_q"])
                    posted = _posted(np.vstack(block["_near"].tolist()), ordered)
                    held = []
                for c in range(0, len(part), 1024):
                    some = part.iloc[c : c + 1024]
                    mine = some["_id"].to_numpy()
                    weight = _weights(np.vstack(some["_near"].tolist()), posted, len(ids), ordered)
                    own = _matrix(some["_q"])
                    near = own @ matrix.T  # the block's cosines at once; only candidates keep theirs
                    near[(weight < least) | (mine[:, None] == ids[None, :])] = -2
                    most = min(k + SPARE, len(ids))
                    j = np.argpartition(-near, most - 1, axis=1)[:, :most].ravel()
                    i = np.repeat(np.arange(len(some)), most)
                    found = near[i, j] > -2
                    i, j = i[found], j[found]
                    if not len(i):
                        continue
                    cos = np.einsum("ij,ij->i", own[i], matrix[j], dtype=np.float64)
                    order = np.lexsort((ids[j], -cos, i))
                    i, j, cos = i[order], j[order], cos[order]
                    first = np.r_[True, i[1:] != i[:-1]]
                    rank = np.arange(len(i)) - np.maximum.accumulate(np.where(first, np.arange(len(i)), 0))
                    top = rank < k
                    out.append(pd.DataFrame({"_id": mine[i[top]], "_other": ids[j[top]], "_cos": cos[top]}))
            yield pd.concat(out) if out else pd.DataFrame({"_id": [], "_other": [], "_cos": []})

    return run


def nearest(
    vectors: DataFrame, k: int = K, ordered: int = ORDERED, visited: int = VISITED, block: int = BLOCK, least: int = LEAST_WEIGHT,
) -> DataFrame:
    """(vec_id, other_id, cosine, rank): up to k most similar other vectors of every usable vector (from usable()).

    Equal vectors form one class, searched once; a vector's list is filled from its own class (cosine 1) and the classes
    found, by cosine (to nine digits) and then by smaller id, so a hot group of copies costs one search and k rows per vector.

    A class is represented by its ordered nearest pivots (a sample of classes by hashed id). It is posted in the
    inverted files of its first POSTED pivots and asks the files of its first visited pivots. There rank weights of shared
    pivots are accumulated (the footrule distance), candidates of enough weight get their exact cosine, and the k best
    of every file are merged. Files of more than block classes are split; every block is asked. A query meets blocks as
    a stream, so no file is held whole.

    An empty input gives an empty result; a single vector has no others. Recall against brute force is in the tests.
    """
    spark = vectors.sparkSession
    tasks = parallelism(spark)
    packed = cut(vectors.mapInPandas(_packed, "_id bigint, _q binary"))
    by_class = Window.partitionBy("_q").orderBy("_id")
    first = packed.withColumn("_nth", F.row_number().over(by_class)).where(F.col("_nth") <= k + 1)
    classes = first.groupBy("_q").agg(F.min("_id").alias("_rep"), F.array_sort(F.collect_list("_id")).alias("_ids"))
    classes = cut(classes)
    reps = classes.select(F.col("_rep").alias("_id"), "_q")
    n = classes.count()
    wanted = int(min(MOST_PIVOTS, max(FEWEST_PIVOTS, PIVOTS * n**0.5)))
    chosen = reps.orderBy(F.xxhash64("_id"), "_id").limit(wanted).toPandas()
    pivots = _matrix(chosen["_q"]) if len(chosen) else np.zeros((0, 1), np.float32)
    shared = spark.sparkContext.broadcast(pivots)
    if len(chosen):
        permuted = cut(reps.repartition(tasks).mapInPandas(_permuted(shared, ordered), "_id bigint, _q binary, _near array<int>"))
    else:
        permuted = reps.withColumn("_near", F.array().cast("array<int>"))
    filed = permuted.select("_id", "_q", "_near", F.explode(F.slice("_near", 1, POSTED)).alias("_cell"))
    blocks = filed.groupBy("_cell").agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    posted = filed.join(blocks, "_cell").select(
        "_cell", F.pmod(F.xxhash64("_id"), F.col("_blocks")).cast("int").alias("_block"), F.lit(0).alias("_kind"), "_id", "_q", "_near"
    )
    asked = permuted.select("_id", "_q", "_near", F.explode(F.slice("_near", 1, visited)).alias("_cell")).join(blocks, "_cell").select(
        "_cell", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"), F.lit(1).alias("_kind"), "_id", "_q", "_near"
    )
    stream = posted.unionByName(asked).repartition(tasks, "_cell", "_block").sortWithinPartitions("_cell", "_block", "_kind")
    found = stream.mapInPandas(_ranked(k, ordered, min(least, ordered * (ordered + 1) // 2)), "_id bigint, _other bigint, _cos double")
    # a pair may meet in two files: its cosine is the same there, and what rounding leaves of it goes by id
    every = F.array_sort(F.collect_list(F.struct((-F.round("_cos", 9)).alias("c"), F.col("_other").alias("o"))))
    some = found.groupBy("_id").agg(F.slice(F.array_distinct(every), 1, k + SPARE).alias("_some"))
    single = F.filter("_some", lambda x, i: ~F.exists(F.slice(F.col("_some"), F.lit(1), i), lambda y: y["o"] == x["o"]))
    best = some.select("_id", F.slice(single, 1, k).alias("_best"))
    others = best.select(F.col("_id").alias("_rep"), F.explode("_best").alias("_b")).select("_rep", F.col("_b.o").alias("_of"), (-F.col("_b.c")).alias("_cos"))
    lists = classes.select(F.col("_rep").alias("_of"), "_ids")
    filled = others.join(lists, "_of").select("_rep", "_cos", F.explode("_ids").alias("_other"))
    own = classes.select("_rep", F.lit(1.0).alias("_cos"), F.explode("_ids").alias("_other"))
    ranked = (
        filled.unionByName(own)
        .groupBy("_rep")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("_cos")).alias("c"), F.col("_other").alias("o")))), 1, k + 1).alias("_best"))
    )
    members = packed.join(classes.select("_q", "_rep"), "_q").select("_id", "_rep")
    each = members.join(ranked, "_rep").select("_id", F.filter("_best", lambda x: x["o"] != F.col("_id")).alias("_best"))
    return each.select("_id", F.posexplode(F.slice("_best", 1, k)).alias("_n", "_b")).select(
        F.col("_id").alias("vec_id"), F.col("_b.o").alias("other_id"), (-F.col("_b.c")).alias("cosine"), (F.col("_n") + 1).alias("rank")
    )


def similar_pairs(lists: DataFrame, least: float) -> DataFrame:
    """(vec_a, vec_b) of cosine least or more, one of which is in the other's list; smaller id first, once."""
    near = lists.where(F.col("cosine") >= least)
    return near.select(F.least("vec_id", "other_id").alias("vec_a"), F.greatest("vec_id", "other_id").alias("vec_b")).distinct()
