"""Problem 2: long exact spans shared between records (repeated-phrase automata)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.session import cut, parallelism

#: Shortest shared span, and the length of the phrases by which spans are first met (code points).
SPAN, PHRASE = 120, 80
#: Phrases that one automaton holds, and texts that one task of a shard streams.
SHARD_PHRASES, SHARD_TEXTS = 5_000, 20_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _gram_hashes(codes: np.ndarray, size: int, seed: int) -> np.ndarray:
    """64-bit hash of every run of size code points (doubling: two halves that overlap cover a run)."""
    with np.errstate(over="ignore"):
        level, width = _mix(codes.astype(np.uint64) + np.uint64(seed)), 1
        while 2 * width <= size:
            level = _mix(level[: len(level) - width] * _ODD + level[width:])
            width *= 2
        if width < size:
            rest = size - width
            level = _mix(level[: len(level) - rest] * _ODD + level[rest:])
    return level


def _window(values: np.ndarray, size: int, least: bool) -> np.ndarray:
    """Least (or greatest) value of every window of size values."""
    pick = np.minimum if least else np.maximum
    width = 1
    while 2 * width <= size:
        values = pick(values[: len(values) - width], values[width:])
        width *= 2
    if width < size:
        values = pick(values[: len(values) - (size - width)], values[size - width :])
    return values


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def anchors(texts: list[str], span: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, start) of the phrases that are least in one of their windows, of all texts at once: any two texts with a
    common run of span code points choose a common phrase within it, for the choice depends on the run alone."""
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    codes = _codes("".join(texts))
    if len(codes) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = _gram_hashes(codes, phrase, 1)
    wide = span - phrase + 1
    lowest = _window(hashes, wide, True)
    # a window that reaches into the next text is nobody's: no phrase is least in it
    starts = np.arange(len(lowest))
    text = np.searchsorted(ends, starts, "right")
    lowest[starts + span > ends[text]] = 0
    padded = np.concatenate([np.zeros(wide - 1, np.uint64), lowest, np.zeros(wide - 1, np.uint64)])
    at = np.flatnonzero((_window(padded, wide, False) == hashes) & (hashes != 0))
    text = np.searchsorted(ends, at, "right")
    return text, at - (ends[text] - sizes[text])


def _pieces(batch: pd.DataFrame, most: int = 1 << 21) -> Iterator[pd.DataFrame]:
    """A batch in parts of about so many characters (or of one longer text)."""
    part = np.cumsum(batch["_text"].str.len().to_numpy()) // most
    for _, rows in batch.groupby(part, sort=True):
        yield rows


def _anchor_rows(span: int, phrase: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows in _pieces(batch):
                texts = rows["_text"].tolist()
                of, at = anchors(texts, span, phrase)
                found = pd.DataFrame({"_of": of, "_at": at, "_text": [texts[i][p : p + phrase] for i, p in zip(of.tolist(), at.tolist())]})
                found = found.drop_duplicates(["_of", "_text"])
                hashes = pd.util.hash_array(found["_text"].to_numpy(object), categorize=False).view(np.int64)
                own = rows.iloc[found["_of"].to_numpy()]
                yield pd.DataFrame({"_fld": own["_fld"].to_numpy(), "_key": own["_key"].to_numpy(), "_hash": hashes, "_at": found["_at"].to_numpy(np.int32)})

    return run


def _located(span: int, phrase: int):
    """Rows come sorted by (shard, part), phrases before texts: build the automaton, stream the texts through it, and
    give the hashed windows of span code points around every occurrence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        at, automaton, ready = None, None, False
        for batch in batches:
            out: list[tuple] = []
            for shard, part, is_text, fld, key, text in batch.itertuples(index=False):
                if (shard, part) != at:
                    at, automaton, ready = (shard, part), ahocorasick.Automaton(), False
                if not is_text:
                    automaton.add_word(text, 1)
                    continue
                if not len(automaton):
                    continue
                if not ready:
                    automaton.make_automaton()
                    ready = True
                ends = np.fromiter((e for e, _ in automaton.iter(text)), np.int64)
                if not len(ends):
                    continue
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                first = ends - phrase + 1
                last = len(codes) - span
                # all windows that contain an occurrence
                marks = np.zeros(last + 2, np.int64)
                np.add.at(marks, np.clip(first - (span - phrase), 0, last + 1), 1)
                np.add.at(marks, np.clip(first + 1, 0, last + 1), -1)
                starts = np.flatnonzero(np.cumsum(marks[: last + 1]) > 0)
                if not len(starts):
                    continue
                one, two = _gram_hashes(codes, span, 2)[starts], _gram_hashes(codes, span, 3)[starts]
                out.append((fld, int(key), starts.astype(np.int32), one.view(np.int64), two.view(np.int64)))
            yield pd.DataFrame(out, columns=["_fld", "_key", "_at", "_one", "_two"])

    return run


def shared_windows(texts: DataFrame, span: int = SPAN, phrase: int = PHRASE) -> DataFrame:
    """(_fld, _key, _at): every start of a window of span code points that also stands in another text of the field.

    1. Every text chooses phrases by their content; those chosen in two or more texts of a field recur (combined before
       the exchange; only a hash, a place and the least and greatest key travel).
    2. The recurring phrases, in their own words, are spread over shards of SHARD_PHRASES; texts go to the shards of
       phrases they chose. A shard that many texts go to is worked on in parts, each with its own automaton, and every
       part streams its texts through it: sorted input, no group is held.
    3. Windows around the occurrences, by two 64-bit hashes, are counted over texts, combined before the exchange.
    """
    spark = texts.sparkSession
    tasks = parallelism(spark)
    texts = texts.where((F.length("_text") >= span) & F.col("_key").isNotNull() & F.col("_fld").isNotNull())
    chosen = cut(texts.select("_fld", "_key", "_text").mapInPandas(_anchor_rows(span, phrase), "_fld string, _key bigint, _hash bigint, _at int"))
    recurring = (
        chosen.groupBy("_fld", "_hash")
        .agg(F.min(F.struct("_key", "_at")).alias("_rep"), F.max("_key").alias("_most"))
        .where(F.col("_rep._key") < F.col("_most"))
        .select("_fld", "_hash", F.col("_rep._key").alias("_key"), F.col("_rep._at").alias("_at"))
    )
    recurring = cut(recurring)
    shards = max(1, -(-recurring.count() // SHARD_PHRASES))
    shard = F.pmod(F.xxhash64("_fld", "_hash"), F.lit(shards)).cast("int").alias("_shard")
    routes = cut(chosen.join(recurring.select("_fld", "_hash"), ["_fld", "_hash"], "left_semi").select(shard, "_fld", "_key").distinct())
    parts = routes.groupBy("_shard").agg(F.ceil(F.count("*") / SHARD_TEXTS).cast("int").alias("_parts"))
    phrases = (
        recurring.join(texts, ["_fld", "_key"])
        .select(shard, F.substring(F.col("_text"), F.col("_at") + 1, F.lit(phrase)).alias("_text"))
        .join(parts, "_shard")
        .select("_shard", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.lit(0).alias("_kind"), F.lit("").alias("_fld"), F.lit(0).cast("bigint").alias("_key"), "_text")
    )
    routed = (
        routes.join(texts, ["_fld", "_key"])
        .join(parts, "_shard")
        .select("_shard", F.pmod(F.xxhash64("_key"), F.col("_parts")).cast("int").alias("_part"), F.lit(1).alias("_kind"), "_fld", "_key", "_text")
    )
    streams = phrases.unionByName(routed).repartition(tasks, "_shard", "_part")
    streams = streams.sortWithinPartitions("_shard", "_part", "_kind")
    windows = cut(
        streams.mapInPandas(_located(span, phrase), "_fld string, _key bigint, _at array<int>, _one array<bigint>, _two array<bigint>")
    )
    each = windows.select("_fld", "_key", F.explode(F.arrays_zip("_at", "_one", "_two")).alias("_w")).select(
        "_fld", "_key", F.col("_w._at").alias("_at"), F.col("_w._one").alias("_one"), F.col("_w._two").alias("_two")
    )
    common = (
        each.groupBy("_fld", "_one", "_two")
        .agg(F.min("_key").alias("_least"), F.max("_key").alias("_most"))
        .where("_least < _most")
        .select("_fld", "_one", "_two")
    )
    return each.join(common, ["_fld", "_one", "_two"], "left_semi").select("_fld", "_key", "_at")


def shared_spans(texts: DataFrame, group: str, key: str, field: str, span: int = SPAN, phrase: int = PHRASE) -> DataFrame:
    """(group, key, chars, shared_chars, share, spans): for every text with a run of at least span code points that
    also stands in another text of its group, its length, how many of its characters lie in such runs, their share, and
    how many runs they form once touching ones are joined.

    Texts are compared as stored. Null, empty and shorter texts share nothing and give no row; a run that recurs only
    within its own text isn't shared. Texts need one row per (group, key), keys are BIGINT. Rows without a key or group
    are left out. A text's own starts are gathered in one row, which is bounded by its length.
    """
    source = texts.select(F.col(group).cast("string").alias("_fld"), F.col(key).alias("_key"), F.col(field).alias("_text"))
    starts = shared_windows(source, span, phrase)
    sorted_starts = F.array_sort(F.collect_set("_at"))
    walk = F.aggregate(
        "_starts",
        F.struct(F.lit(-1).alias("end"), F.lit(0).alias("chars"), F.lit(0).alias("spans")),
        lambda acc, s: F.struct(
            (s + span).alias("end"),
            (acc["chars"] + s + span - F.greatest(acc["end"], s)).alias("chars"),
            (acc["spans"] + F.when(s > acc["end"], 1).otherwise(0)).alias("spans"),
        ),
    )
    covered = starts.groupBy("_fld", "_key").agg(sorted_starts.alias("_starts")).withColumn("_walk", walk)
    lengths = source.select("_fld", "_key", F.length("_text").alias("chars"))
    return covered.join(lengths, ["_fld", "_key"]).select(
        F.col("_fld").alias(group), F.col("_key").alias(key), "chars", F.col("_walk.chars").alias("shared_chars"),
        (F.col("_walk.chars") / F.col("chars")).alias("share"), F.col("_walk.spans").alias("spans"),
    )
