"""Problem 7: frequency of every distinct term (burst tries, merged across workers)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.words import WordReader
from siftline.session import cut, parallelism

#: Terms a container holds before it bursts, and terms a worker holds before it hands its trie on.
CONTAINER = 256
WORKER_TERMS = 400_000
#: Terms (counted once per worker) that one route may have before it is split by the next character, and characters
#: that a round of splitting looks at; the next round looks at twice as many, and only at terms whose route is still full.
ROUTE_TERMS = 50_000
FIRST_LOOK = 8

_PART = "prefix string, suffixes array<string>, tfs array<bigint>, dfs array<bigint>"


class BurstTrie:
    """Inner nodes are dicts by character, containers dicts from suffix to [occurrences, records].

    The empty character of an inner node holds the term that ends there.
    """

    __slots__ = ("limit", "root", "size")

    def __init__(self, limit: int = CONTAINER) -> None:
        self.limit, self.root, self.size = limit, _Container(), 0

    def add(self, term: str, tf: int, df: int) -> None:
        at, parent, depth = self.root, None, 0
        while type(at) is dict:
            parent, char = at, term[depth : depth + 1]
            at = parent.get(char)
            if at is None:
                at = parent[char] = _Container()
            depth += 1
        suffix = term[depth:]
        got = at.get(suffix)
        if got is not None:
            got[0] += tf
            got[1] += df
            return
        at[suffix] = [tf, df]
        self.size += 1
        if len(at) > self.limit and (parent is None or term[depth - 1 : depth]):
            node: dict = {}
            for rest, counts in at.items():
                node.setdefault(rest[:1], _Container())[rest[1:]] = counts
            if parent is None:
                self.root = node
            else:
                parent[term[depth - 1 : depth]] = node

    def containers(self) -> Iterator[tuple[str, dict]]:
        todo = [("", self.root)]
        while todo:
            prefix, at = todo.pop()
            if type(at) is dict:
                todo.extend((prefix + char, child) for char, child in at.items())
            elif at:
                yield prefix, at


class _Container(dict):
    pass


def _part(trie: BurstTrie) -> pd.DataFrame:
    rows = [(p, list(c), [x[0] for x in c.values()], [x[1] for x in c.values()]) for p, c in trie.containers()]
    return pd.DataFrame(rows, columns=["prefix", "suffixes", "tfs", "dfs"])


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    reader, trie = WordReader(), BurstTrie()
    for batch in batches:
        met: dict[str, list[int]] = {}
        for text in batch["text"]:
            own: dict[str, int] = {}
            for word in reader.words(text):
                own[word] = own.get(word, 0) + 1
            for word, n in own.items():
                got = met.get(word)
                if got is None:
                    met[word] = [n, 1]
                else:
                    got[0] += n
                    got[1] += 1
        for word, (tf, df) in met.items():
            trie.add(word, tf, df)
        if trie.size > WORKER_TERMS:
            yield _part(trie)
            trie = BurstTrie()
    if trie.size:
        yield _part(trie)


def _routed(burst: frozenset[str]):
    """Split the containers at the burst prefixes; a term's route is its shortest prefix that isn't burst."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: dict[tuple[str, str], list[list]] = {}
            for prefix, suffixes, tfs, dfs in batch.itertuples(index=False):
                for suffix, tf, df in zip(suffixes, tfs, dfs):
                    term, k = prefix + suffix, 1
                    while k < len(term) and term[:k] in burst:
                        k += 1
                    to = out.setdefault((term[:k], prefix), [[], [], []])
                    to[0].append(suffix)
                    to[1].append(tf)
                    to[2].append(df)
            if out:
                yield pd.DataFrame(
                    [(route, prefix, *lists) for (route, prefix), lists in out.items()],
                    columns=["route", "prefix", "suffixes", "tfs", "dfs"],
                )

    return run


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by route: one trie at a time."""
    route, trie = None, BurstTrie()

    def rows() -> pd.DataFrame:
        found = [(p + s, tf, df) for p, c in trie.containers() for s, (tf, df) in c.items()]
        return pd.DataFrame(found, columns=["term", "tf", "df"])

    for batch in batches:
        for at, prefix, suffixes, tfs, dfs in batch.itertuples(index=False):
            if at != route:
                if trie.size:
                    yield rows()
                route, trie = at, BurstTrie()
            for suffix, tf, df in zip(suffixes, tfs, dfs):
                trie.add(prefix + suffix, int(tf), int(df))
    if trie.size:
        yield rows()


def term_counts(records: DataFrame, field: str, route_terms: int = ROUTE_TERMS) -> DataFrame:
    """(term, tf, df): occurrences of every word of the field, and records with it. One input row is one record.

    Every worker fills a burst trie and hands its containers on, so a word crosses the network once per worker however
    often it occurs. The prefixes that are too full over all workers are burst into longer routes, to any depth, until
    none but a single term has more than route_terms counted terms; a task holds one route's trie at a time. Only burst
    prefixes come to the driver: at most the length of a common beginning for every route_terms counted terms of the
    vocabulary (not of the text). Matching subtrees of all workers meet in one task per route.

    Null and empty texts have no words; an empty input gives an empty result.
    """
    spark = records.sparkSession
    parts = cut(records.select(F.col(field).alias("text")).mapInPandas(_count, _PART))
    total = parts.agg(F.sum(F.size("suffixes"))).first()[0] or 0
    burst: set[str] = set()
    terms = parts.select(F.explode(F.transform("suffixes", lambda s: F.concat(F.col("prefix"), s))).alias("t"))
    seen, look = 0, FIRST_LOOK
    while total > route_terms:
        ends = F.sequence(F.lit(seen + 1), F.least(F.length("t"), F.lit(seen + look)))
        longer = terms.where(F.length("t") > seen)
        heads = longer.select(F.explode(F.transform(ends, lambda k: F.substring(F.col("t"), F.lit(1), k))).alias("head"))
        full = [r.head for r in heads.groupBy("head").count().where(F.col("count") > route_terms).select("head").toLocalIterator()]
        burst.update(full)
        seen, look = seen + look, look * 2
        deepest = [h for h in full if len(h) == seen]
        if not deepest:
            break
        met = spark.createDataFrame([(h,) for h in deepest], "_head string")
        terms = terms.join(F.broadcast(met), F.substring("t", 1, seen) == F.col("_head"), "left_semi")
    routed = parts.mapInPandas(_routed(frozenset(burst)), "route string, " + _PART)
    placed = routed.repartition(parallelism(spark), "route").sortWithinPartitions("route")
    return placed.mapInPandas(_merged, "term string, tf bigint, df bigint")


def marked(counts: DataFrame, records: Column | int, cutoff: Column | float) -> DataFrame:
    """counts with a mark: `common` if in more than floor(cutoff * records) records, `rare` if in one, else null.

    A null cutoff marks nothing as common. A term in both ranges (one record in all) is common.
    """
    mark = F.when(F.col("df") > F.floor(F.lit(cutoff) * F.lit(records)), "common").when(F.col("df") == 1, "rare")
    return counts.withColumn("mark", mark)
