"""Problem 4: near-duplicate records with small edits (chosen-path set similarity join)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.words import WordReader
from siftline.session import cut, parallelism, release, tidy

#: Independent trees, and children that a node has for each of its records: with similarity s a pair stays together
#: in a tree as long as a branching process with mean 2 s lives (0.85 at s = 0.7 over three levels).
TREES, CHILDREN = 6, 2
#: Records up to which a node is compared exhaustively. A node that keeps more than STUCK of its parent, and did so the
#: level before, no longer shrinks: up to LARGE records it is compared exhaustively, beyond that its records are told
#: apart by their rarest tokens.
SMALL, STUCK, LARGE = 256, 0.85, 2_048
DEEPEST = 24
#: Records of one side of a comparison in one task: larger leaves are compared in pairs of blocks.
BLOCK = 512
#: Minwise tokens per record that the paths choose from, in bands: every level has its own, so its coordinates are fresh.
BANDS, BAND = 8, 8
COORDINATES = BANDS * BAND
#: One-bit minwise sketch: bits, and the deviations below the expectation at the threshold from which a pair is dropped.
BITS, DEVIATIONS = 256, 5.0
#: Rows in hand at a time, for each class of equal sets and at least: what goes beyond is worked on part after part, so the
#: disk in use follows the records and not the nodes they are in. Nothing is left out by it.
SHARE, FEWEST = 8, 2_000_000
#: Rows that a worker compares at once, and pairs that it hands on at once.
CHUNK, HANDED = 100_000, 1_000_000


def word_sets(records: DataFrame, key: str, *fields: str) -> DataFrame:
    """(_id, _set): sorted 64-bit hashes of the distinct words of all fields; records without words are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = WordReader()
        for batch in batches:
            columns = [batch[f"_f{i}"] for i in range(len(fields))]
            sets = [sorted({w for text in texts for w in reader.words(text)}) for texts in zip(*columns)]
            flat = np.array([w for s in sets for w in s], object)
            hashes = pd.util.hash_array(flat, categorize=True).view(np.int64) if len(flat) else np.zeros(0, np.int64)
            parts = np.split(hashes, np.cumsum([len(s) for s in sets])[:-1]) if sets else []
            kept = [(k, np.unique(p)) for k, p in zip(batch["_id"].tolist(), parts) if len(p)]
            yield pd.DataFrame(kept, columns=["_id", "_set"])

    source = records.where(F.col(key).isNotNull()).select(F.col(key).alias("_id"), *[F.col(f).alias(f"_f{i}") for i, f in enumerate(fields)])
    return source.mapInPandas(run, "_id bigint, _set array<bigint>")


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rng = np.random.default_rng(20)
    total = COORDINATES + BITS
    by = rng.integers(1, 1 << 62, total, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for batch in batches:
        if not len(batch):
            continue
        sets = batch["_set"].tolist()
        flat = np.concatenate(sets).view(np.uint64)
        starts = np.r_[0, np.cumsum([len(s) for s in sets])[:-1]]
        lows = np.empty((len(sets), total), np.uint32)
        with np.errstate(over="ignore"):
            for j in range(total):
                x = (flat ^ (flat >> np.uint64(31)) ^ by[j]) * by[j]
                lows[:, j] = np.minimum.reduceat(((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32), starts)
        minwise = lows[:, :COORDINATES].view(np.int32)
        mixed = (lows[:, COORDINATES:] * np.uint32(0x9E3779B1)) >> np.uint32(31)
        bits = np.packbits(mixed.astype(np.uint8), axis=1).view(">i8").astype(np.int64)
        out = {"_id": batch["_id"], "_size": [len(s) for s in sets]} | {f"_m{k}": list(minwise[:, k * BAND : (k + 1) * BAND]) for k in range(BANDS)}
        yield pd.DataFrame(out | {f"_s{i}": bits[:, i] for i in range(BITS // 64)})


_FEATURES = "_id bigint, _size int, " + ", ".join(f"_m{k} array<int>" for k in range(BANDS)) + ", " + ", ".join(f"_s{i} bigint" for i in range(BITS // 64))


def _parts(rows: int, most: int) -> int:
    return max(1, -(-rows // most))


def _part(frame: DataFrame, k: int, parts: int, *by: str) -> DataFrame:
    """The k-th of some parts of a frame: rows of one value of the named columns stay together."""
    return frame if parts == 1 else frame.where(F.pmod(F.xxhash64(*by, F.lit(-1)), F.lit(parts)) == k)


def _leaves(features: DataFrame, classes: int, most: int) -> Iterator[tuple[DataFrame, DataFrame]]:
    """(_id, _node, _n) and (_id) again and again: nodes of _n records in which records are to be compared with each other,
    and records of nodes that don't shrink. What is handed out is dropped when the next is asked for.

    Level by level: every record goes to CHILDREN children of its node, each chosen by one coordinate of the level's band
    (which one, the node decides) and the record's minwise token there; a level moves no other tokens. Nodes of at most
    SMALL records are leaves. Nodes that twice in a row keep more than STUCK of their parent hold records that are nearly
    all alike, or have nothing rarer than what they share among their coordinates: they branch no further by minwise
    tokens, and up to LARGE records they are leaves as well. All others branch again. As soon as a level would have more
    than most rows, its nodes are split into parts, and each part goes down by itself.
    """
    each = max(1, most // max(1, CHILDREN * classes))
    waiting: list[tuple[DataFrame, int, list[DataFrame]]] = []
    for first in range(0, TREES, each):
        trees = F.array(*[F.lit(t).cast("bigint") for t in range(first, min(TREES, first + each))])
        rows = features.select("_id", F.explode(trees).alias("_node"))
        waiting.append((rows.withColumn("_parent_size", F.lit(None).cast("bigint")).withColumn("_held", F.lit(0)), 0, []))
    tables: list[DataFrame] = []
    held = 0
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    while waiting:
        rows, level, own = waiting.pop()
        band = features.select("_id", F.col(f"_m{level % BANDS}").alias("_band"))
        level += 1
        start = F.pmod(F.xxhash64("_node", F.lit(level)), F.lit(BAND))
        step = 1 + F.pmod(F.xxhash64(F.lit(level), "_node"), F.lit(BAND - 1))
        places = [F.pmod(start + i * step, F.lit(BAND)).cast("int") for i in range(CHILDREN)]
        child = F.array(*[F.xxhash64("_node", F.lit(i), F.element_at("_band", p + 1)) for i, p in enumerate(places)])
        moved = cut(rows.join(band, "_id").select("_id", "_parent_size", "_held", F.explode(child).alias("_node")))
        sizes = moved.groupBy("_node").agg(F.count("*").alias("_n"), F.max("_parent_size").alias("_up"), F.max("_held").alias("_held"))
        stays = F.coalesce(F.col("_n") > F.col("_up") * STUCK, F.lit(False))
        known = sizes.where(F.col("_n") > 1).select("_node", "_n", F.when(stays, F.col("_held") + 1).otherwise(0).alias("_held"))
        still = F.col("_held") >= 2
        leaf = (F.col("_n") <= SMALL) | (still & (F.col("_n") <= LARGE))
        stuck = still if level < DEEPEST else F.lit(True)
        many = known.withColumn("_kind", F.when(leaf, "leaf").when(stuck, "stuck").otherwise("rest"))
        judged = cut(moved.select("_id", "_node").join(many, "_node"))
        release(moved, *own)
        number = {r["_kind"]: r["count"] for r in judged.groupBy("_kind").count().collect()}
        rest = judged.where("_kind = 'rest'").select("_id", "_node", F.col("_n").alias("_parent_size"), "_held")
        parts = _parts(number.get("rest", 0) * CHILDREN, most)
        tables.append(judged)
        if parts > 1:
            below = [cut(_part(rest, k, parts, "_node")) for k in range(parts)]
            waiting += [(table, level, [table]) for table in below]
        elif "rest" in number:
            waiting.append((rest, level, []))
        held += number.get("leaf", 0) + number.get("stuck", 0)
        if held > most or not waiting:
            yield union([t.where("_kind = 'leaf'").select("_id", "_node", "_n") for t in tables]), union([t.where("_kind = 'stuck'").select("_id") for t in tables])
            needed = [judged] if parts == 1 and "rest" in number else []
            release(*[t for t in tables if not any(t is n for n in needed)])
            if needed:
                waiting[-1] = (rest, level, needed)
            tables, held = [], 0


def _by_rare_tokens(stuck: DataFrame, classes: DataFrame, least: float, most: int) -> list[DataFrame]:
    """(_id, _node, _n), in tables: the records of stuck nodes branched by each of their rarest tokens, so many of them that two
    sets of the least similarity share one: no pair is lost, and what all records share keeps none of them together."""
    own = cut(classes.join(stuck.select("_id").distinct(), "_id", "left_semi"))
    words = own.agg(F.coalesce(F.sum(F.size("_set")), F.lit(0))).first()[0]
    spread = cut(own.select(F.explode("_set").alias("_token")).groupBy("_token").agg(F.count("*").alias("_df")))
    ordered = F.array_sort(F.collect_list(F.struct("_df", "_token")))
    size = F.size("_t")
    rarest = F.slice("_t", F.lit(1), (size - F.ceil(size * least - 1e-9) + 1).cast("int"))
    found, parts = [], _parts(words, most)
    for k in range(parts):
        tokens = _part(own, k, parts, "_id").select("_id", F.explode("_set").alias("_token"))
        first = tokens.join(spread, "_token").groupBy("_id").agg(ordered.alias("_t"))
        each = first.select("_id", F.explode(rarest).alias("_r")).where("_r._df > 1")
        found.append(cut(each.select("_id", F.xxhash64(F.lit(TREES), "_r._token").alias("_node"))))
    release(own, spread)
    every = reduce(DataFrame.unionByName, found)
    parts = _parts(every.count(), most)
    leaves = []
    for k in range(parts):
        part = _part(every, k, parts, "_node")
        leaves.append(cut(part.join(part.groupBy("_node").agg(F.count("*").alias("_n")).where("_n > 1"), "_node").select("_id", "_node", "_n")))
    release(*found)
    return leaves


def _meetings(leaves: DataFrame) -> DataFrame:
    """(_key, _side, _id): every two records of a leaf meet once, under some key. A leaf of more than BLOCK records is split,
    and every pair of its blocks is a key of its own, whose records have sides 1 and 2; within a block all have side 0."""
    rows = leaves.withColumn("_blocks", F.ceil(F.col("_n") / BLOCK).cast("int")).withColumn("_block", F.pmod(F.xxhash64("_id"), F.col("_blocks")).cast("int"))
    side = lambda other, own: F.when(other == own, 0).when(own < other, 1).otherwise(2)
    met = lambda other: F.struct(
        F.xxhash64("_node", F.least(other, F.col("_block")), F.greatest(other, F.col("_block"))).alias("_key"), side(other, F.col("_block")).alias("_side")
    )
    each = F.explode(F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), met)).alias("_m")
    return rows.select("_id", each).select("_m._key", "_m._side", "_id")


_SKETCH = [f"_s{i}" for i in range(BITS // 64)]


def _compared(least: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Pairs of records that meet and aren't clearly unlike, from rows in the order of their key and then of their size."""
    alike = (1 + least) / 2
    fewest = BITS * alike - DEVIATIONS * (BITS * alike * (1 - alike)) ** 0.5

    def told(near: list[np.ndarray]) -> pd.DataFrame:
        a, b = (np.concatenate(x) for x in zip(*near))
        return pd.DataFrame({"_a": np.minimum(a, b), "_b": np.maximum(a, b)}).drop_duplicates()

    def within(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        key, side, ids, size = (rows[c].to_numpy() for c in ("_key", "_side", "_id", "_size"))
        sketch = [rows[s].to_numpy().view(np.uint64) for s in _SKETCH]  # bits of a negative number would be those of its amount
        borders = np.flatnonzero(np.r_[key[1:] != key[:-1], True]) + 1
        ends = np.repeat(borders, np.diff(np.r_[0, borders]))
        left, apart, near, found = np.arange(len(key)), 0, [], 0
        while True:
            apart += 1
            left = left[left + apart < ends[left]]
            left = left[size[left] >= least * size[left + apart] - 1e-9]  # partners further on are larger still
            if not len(left):
                break
            right = left + apart
            unlike = np.zeros(len(left), np.uint16)
            for s in sketch:
                unlike += np.bitwise_count(s[left] ^ s[right])
            kept = (BITS - unlike.astype(np.int32) >= fewest) & ((side[left] == 0) | (side[left] != side[right]))
            if kept.any():
                near.append((ids[left[kept]], ids[right[kept]]))
                found += len(near[-1][0])
            if found > HANDED:
                yield told(near)
                near, found = [], 0
        if near:
            yield told(near)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= CHUNK:
                whole = pd.concat(held, ignore_index=True)
                ended = int(np.argmax(whole["_key"].to_numpy() == whole["_key"].iloc[-1]))  # the last key may go on
                yield from within(whole.iloc[:ended])
                held, rows = [whole.iloc[ended:]], len(whole) - ended
        if rows:
            yield from within(pd.concat(held, ignore_index=True))

    return run


def _candidates(leaves: DataFrame, features: DataFrame, least: float, most: int) -> list[DataFrame]:
    """(_a, _b), in tables: pairs of records of a leaf of which the sketches don't tell that they are unlike."""
    meetings = leaves.agg(F.coalesce(F.sum(F.ceil(F.col("_n") / BLOCK)), F.lit(0))).first()[0]
    known = features.select("_id", F.col("_size").cast("bigint").alias("_size"), *_SKETCH)
    found, parts = [], _parts(meetings, most)
    for k in range(parts if meetings else 0):
        rows = _part(_meetings(leaves), k, parts, "_key").join(known, "_id")
        rows = rows.select("_key", "_side", "_id", "_size", *_SKETCH).repartition("_key").sortWithinPartitions("_key", "_size")
        found.append(cut(rows.mapInPandas(_compared(least), "_a bigint, _b bigint")))
    return found


def _decided(candidates: DataFrame, classes: DataFrame, least: float, most: int) -> DataFrame:
    """(_a, _b, common, union) of the candidates that are as similar as that."""
    ends = candidates.select(F.explode(F.array("_a", "_b")).alias("_id")).distinct()
    needed = cut(classes.join(ends, "_id", "left_semi"))
    first = needed.select(F.col("_id").alias("_a"), F.col("_set").alias("_set_a"))
    second = needed.select(F.col("_id").alias("_b"), F.col("_set").alias("_set_b"))
    links, parts = [], _parts(candidates.count(), most)
    for k in range(parts):
        counted = _part(candidates, k, parts, "_a", "_b").join(first, "_a").join(second, "_b").select(
            "_a", "_b", F.size(F.array_intersect("_set_a", "_set_b")).alias("common"), (F.size("_set_a") + F.size("_set_b")).alias("_both")
        )
        near = counted.withColumn("union", F.col("_both") - F.col("common")).where(F.col("common") >= least * F.col("union") - 1e-9)
        links.append(cut(near.select("_a", "_b", "common", "union")))
    release(needed)
    return reduce(DataFrame.unionByName, links)


def similar_sets(sets: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Links (_a, _b, common, union) between classes of equal sets, and membership (_id, _class).

    A class is the records with one set, named by its least id. Candidates come from the leaves of the chosen-path
    trees; a one-bit sketch drops the clearly unlike (a true pair is dropped with a chance under one in a million), and
    the sets themselves decide. Every pair of a leaf is looked at, in blocks: there is no cap on partners. Nodes that don't
    shrink by minwise tokens (records of one template) are split by rare tokens, which loses no pair. Trees, comparisons
    and decisions go in parts of a few rows a record, and every table and shuffle goes as soon as it has been read.
    """
    with tidy(sets.sparkSession):
        return _similar_sets(sets, least)


def _similar_sets(sets: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    keyed = cut(sets.withColumn("_digest", F.unhex(F.sha2(F.array_join(F.transform("_set", lambda x: F.hex(x)), " "), 256))))
    reps = keyed.groupBy("_digest").agg(F.min("_id").alias("_class"))
    members = cut(keyed.select("_id", "_digest").join(reps, "_digest").select("_id", "_class"))
    own = keyed.select("_id", "_set").repartition(parallelism(sets.sparkSession), "_id")
    classes = cut(own.join(members.where("_id = _class").select("_id"), "_id", "left_semi"))
    release(keyed)
    features = cut(classes.mapInPandas(_features, _FEATURES))
    number = features.count()
    most = max(FEWEST, SHARE * number)
    found, stuck = [], []
    for leaves, unshrunk in _leaves(features, number, most):
        found += _candidates(leaves, features, least, most)
        if not unshrunk.isEmpty():
            stuck.append(cut(unshrunk.distinct()))
    if stuck:
        rare = _by_rare_tokens(reduce(DataFrame.unionByName, stuck), classes, least, most)
        found += _candidates(reduce(DataFrame.unionByName, rare), features, least, most)
        release(*stuck, *rare)
    release(features)
    empty = members.select(F.col("_id").alias("_a"), F.col("_class").alias("_b")).limit(0)
    candidates = cut(reduce(DataFrame.unionByName, found, empty).distinct())
    release(*found)
    links = _decided(candidates, classes, least, max(FEWEST // 4, number // 2))
    release(candidates, classes)
    return links, members


def pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """(rec_a, rec_b): every pair of linked records, smaller id first: between linked classes, and within classes."""
    a = members.select(F.col("_class").alias("_a"), F.col("_id").alias("_x"))
    b = members.select(F.col("_class").alias("_b"), F.col("_id").alias("_y"))
    across = links.select("_a", "_b").join(a, "_a").join(b, "_b").select("_x", "_y")
    inside = a.join(b.withColumnRenamed("_b", "_a"), "_a").where("_x < _y").select("_x", "_y")
    both = across.unionByName(inside)
    return both.select(F.least("_x", "_y").alias("rec_a"), F.greatest("_x", "_y").alias("rec_b"))


def components(edges: DataFrame, a: str = "_a", b: str = "_b") -> DataFrame:
    """(_node, _group): connected components named by their least node, by alternating large and small stars.

    Each round moves every edge towards the least node it knows; rounds grow with the logarithm of the longest chain.
    Only edges travel, a round's table is written to the shared folder, and nothing but its sum comes to the driver.
    """
    both = lambda e: e.select("_u", "_v").unionByName(e.select(F.col("_v").alias("_u"), F.col("_u").alias("_v")))
    edges = edges.select(F.greatest(a, b).alias("_u"), F.least(a, b).alias("_v")).where("_u <> _v").distinct()
    before = None
    while True:
        near = both(edges)
        low = near.groupBy("_u").agg(F.least(F.min("_v"), F.col("_u")).alias("_m"))
        large = near.where("_v > _u").join(low, "_u").select(F.col("_v").alias("_u"), F.col("_m").alias("_v")).where("_u <> _v").distinct()
        least = large.groupBy("_u").agg(F.min("_v").alias("_m"))
        small = large.join(least, "_u").select(F.when(F.col("_v") == F.col("_m"), F.col("_u")).otherwise(F.col("_v")).alias("_u"), F.col("_m").alias("_v"))
        edges = cut(small.where("_u <> _v").distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.hash("_u", "_v").cast("bigint")).alias("s")).first()
        if now == before:
            break
        before = now
    ends = edges.select(F.col("_u").alias("_node"), F.col("_v").alias("_group"))
    return ends.unionByName(edges.select(F.col("_v").alias("_node"), F.col("_v").alias("_group"))).distinct()


def groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """(rec_id, class_id, group_id, links): one row per record with words: its class of equal sets, the least record of
    its group of near-duplicates, and the number of classes its class is linked to."""
    links = cut(links)
    ends = links.select(F.col("_a").alias("_class")).unionByName(links.select(F.col("_b").alias("_class")))
    degree = ends.groupBy("_class").agg(F.count("*").alias("_links"))
    found = components(links).select(F.col("_node").alias("_class"), "_group")
    return members.join(degree, "_class", "left").join(found, "_class", "left").select(
        F.col("_id").alias("rec_id"), F.col("_class").alias("class_id"), F.coalesce("_group", "_class").alias("group_id"),
        F.coalesce("_links", F.lit(0)).alias("links"),
    )
