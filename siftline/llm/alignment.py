"""Problem 5: sentence alignment in bilingual records (chains in bitext space, turned into sentence blocks)."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.words import SPACE, WordReader, py_without_lead
from siftline.session import cut

#: Share of the distinct texts from which a word is common: it hardly marks a place (its row of the bitext space is
#: crowded), so it weighs less, and only where the other words don't decide.
CROWDED = 0.2
#: Rounds in which the lexicon is learned from the alignments so far; association and count from which a pair is kept.
ROUNDS, ASSOCIATED, TOGETHER = 2, 0.1, 2
#: Share of a sentence's words that a chain has to cover, and the share from which it may run in any direction: the parts
#: of a merged sentence may stand in another order, an inversion inside the block.
COVERED, WHOLE = 0.6, 0.8
#: How far a chain's slope may deviate from its rectangle's diagonal and its points scatter around it. Points without any
#: order have slope 0, a deviation of 1, and scatter by the square root of 1/6, 0.41: a chain stays below both.
SLOPE, SCATTER = 1.0, 0.4
#: The same for what other chains left of a sentence: share, points, and share of the words between its ends.
REST, REST_POINTS, DENSE = 0.4, 4, 0.7
AND = "\u0648"
_END = re.compile(f"(?<=[.!?\\u061f])[{SPACE}]+")


def sentences(text: str) -> list[str]:
    return _END.split(text.strip(SPACE))


def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    reader = WordReader()
    stems: dict[str, str] = {}

    def stem(word: str) -> str:
        got = stems.get(word)
        if got is None:
            if len(stems) > 200_000:
                stems.clear()
            got = stems[word] = py_without_lead(word)
        return got

    for batch in batches:
        rows = []
        for key, ar, en in batch.itertuples(index=False):
            a = [(i, stem(w)) for i, s in enumerate(sentences(ar)) for w in reader.words(s)]
            e = [(i, w) for i, s in enumerate(sentences(en)) for w in reader.words(s)]
            if a and e:
                rows.append((key, [w for _, w in a], [i for i, _ in a], [w for _, w in e], [i for i, _ in e]))
        yield pd.DataFrame(rows, columns=["_id", "_ar", "_ars", "_en", "_ens"])


_TOKENS = "_id bigint, _ar array<string>, _ars array<int>, _en array<string>, _ens array<int>"


def _chain(a: list[int], b: list[int], near: dict[int, list[int]], slope: float) -> list[tuple[int, int]]:
    """One-to-one points of a rectangle: every word of the first side takes the free partner that lies nearest to the
    line through the rectangle's corner with the slope of the space."""
    free = set(b)
    chain = []
    for x in a:
        best = None
        for y in near.get(x, ()):
            if y in free:
                off = abs((y - b[0]) - slope * (x - a[0]))
                if best is None or off < best[0]:
                    best = off, y
        if best:
            chain.append((x, best[1]))
            free.discard(best[1])
    return chain


def straight(chain: list[tuple[int, int]]) -> bool:
    """Whether a chain rises like the diagonal of the rectangle it spans: the slope of its least-squares line, in that
    diagonal's measure, deviates from it by less than SLOPE, and its points scatter around the diagonal by less than
    SCATTER of the rectangle."""
    x0, x1 = chain[0][0], chain[-1][0]
    y0, y1 = min(y for _, y in chain), max(y for _, y in chain)
    if x1 == x0 or y1 == y0:
        return True
    u = [(x - x0) / (x1 - x0) for x, _ in chain]
    v = [(y - y0) / (y1 - y0) for _, y in chain]
    n, mu, mv = len(chain), sum(u) / len(u), sum(v) / len(v)
    slope = sum((a - mu) * (b - mv) for a, b in zip(u, v)) / sum((a - mu) ** 2 for a in u)
    scatter = math.sqrt(sum((a - b) ** 2 for a, b in zip(u, v)) / n)
    return abs(slope - 1) < SLOPE and scatter < SCATTER


def weight(texts: int, total: int) -> float:
    """Of a word in so many of the texts: 1 up to CROWDED of them, next to nothing for a word of every text."""
    return min(1.0, math.log((total + 1) / texts) / math.log(1 / CROWDED))


def blocks(ar: list[str], ars: list[int], en: list[str], ens: list[int], partners, light: tuple[dict, dict] = ({}, {})) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(ar sentence, en sentence, chain) of every pair of sentences that a chain of correspondences joins.

    Search rectangles lie around the diagonal of the space, one for every row of sentences, and begin with the columns
    that the diagonal crosses there. In them chains are looked for that keep to their slope and scatter (see straight);
    the one that covers the largest share of its shorter side is taken first, then its points' rows and columns are
    noise for all other chains, which are measured anew on what is left. Where no chain fits any more, the rectangles
    grow by a sentence to either side, until they span the space. So a second chain in the same row or column is a
    merged sentence, one away from the diagonal a moved sentence or an inversion; both become blocks.

    light: weights of the common words of either side. Two sentences are measured by their other words; if these don't
    join them, or one of the sentences has none, by all words with their weights. What chains left of a sentence is
    measured by its other words only, unless one of the two had none from the start.
    """
    light_ar, light_en = light
    where: dict[str, list[int]] = {}
    for y, w in enumerate(en):
        where.setdefault(w, []).append(y)
    near: dict[int, list[int]] = {}
    for x, w in enumerate(ar):
        ys = [y for v in partners(w) for y in where.get(v, ())]
        if ys:
            near[x] = ys
    if not near:
        return []
    slope = len(en) / len(ar)
    rows: dict[int, list[int]] = {}
    columns: dict[int, list[int]] = {}
    for x, s in enumerate(ars):
        rows.setdefault(s, []).append(x)
    for y, s in enumerate(ens):
        columns.setdefault(s, []).append(y)
    met: dict[tuple[int, int], int] = {}
    weighed: dict[tuple[int, int], float] = {}
    for x, ys in near.items():
        w = light_ar.get(ar[x], 1.0)
        for t in {ens[y] for y in ys}:
            c = ars[x], t
            met[c] = met.get(c, 0) + 1
            weighed[c] = weighed.get(c, 0.0) + w
    tall, wide = max(ars) + 1, max(ens) + 1
    full_a = {x for x, w in enumerate(ar) if w not in light_ar}
    full_b = {y for y, w in enumerate(en) if w not in light_en}
    bare_rows, bare_columns = set(rows) - {ars[x] for x in full_a}, set(columns) - {ens[y] for y in full_b}
    cut_rows: set[int] = set()
    cut_columns: set[int] = set()

    def measure(i: int, j: int):
        a, b = rows.get(i), columns.get(j)
        if not a or not b:
            return None
        some_a, some_b = [x for x in a if x in full_a], [y for y in b if y in full_b]
        if some_a and some_b:
            if (got := judged(i, j, some_a, some_b, False)) or len(some_a) == len(a) and len(some_b) == len(b):
                return got
        if i not in bare_rows and j not in bare_columns and (i in cut_rows or j in cut_columns):
            return None
        return judged(i, j, a, b, True)

    def judged(i: int, j: int, a: list[int], b: list[int], weighted: bool):
        # no chain has more points, or weighs more, than the words of the row that have a partner in the column
        least = REST if i in cut_rows or j in cut_columns else COVERED
        if weighted:
            if weighed[i, j] < least * min(sum(light_ar.get(ar[x], 1.0) for x in a), sum(light_en.get(en[y], 1.0) for y in b)) - 1e-9:
                return None
        elif met[i, j] < least * min(len(a), len(b)):
            return None
        chain = _chain(a, b, near, slope)
        if not chain:
            return None
        if weighted:
            w_a, w_b = (lambda x: light_ar.get(ar[x], 1.0)), (lambda y: light_en.get(en[y], 1.0))
            held = min(sum(w_a(x) for x, _ in chain), sum(w_b(y) for _, y in chain))
            share = min(1.0, held / min(sum(map(w_a, a)), sum(map(w_b, b))))
        else:
            share = len(chain) / min(len(a), len(b))
        if len(chain) < 2 and (len(chain) < min(len(a), len(b)) or len(a) + len(b) > 4):
            return None
        if share < COVERED:
            if i not in cut_rows and j not in cut_columns or share < REST or len(chain) < REST_POINTS:
                return None
            low, high = min(y for _, y in chain), max(y for _, y in chain)
            between = min(sum(chain[0][0] <= x <= chain[-1][0] for x in a), sum(low <= y <= high for y in b))
            if len(chain) < DENSE * between:
                return None
        if len(chain) > 3 and share < WHOLE and not straight(chain):
            return None
        return len(chain) * share, -abs(i / tall - j / wide), -i, -j, chain

    # rectangles: around every row of the space, from the columns where its diagonal crosses it to both sides
    rings: dict[int, list[tuple[int, int]]] = {}
    for i, j in met:
        rings.setdefault(int(abs((j + 0.5) - (i + 0.5) * wide / tall)), []).append((i, j))
    open_: dict[tuple[int, int], tuple] = {}
    found, taken, seen = [], set(), set()
    radius = -1
    while open_ or rings:
        if not open_:  # no chain fits: the rectangles grow
            radius += 1
            grown = rings.pop(radius, [])
            seen.update(grown)
            open_ = {c: m for c in grown if (m := measure(*c))}
            continue
        (i, j), best = max(open_.items(), key=lambda kv: kv[1][:4])
        found.append((i, j, best[4]))
        also = _chain(rows[i], columns[j], near, slope) if light_ar or light_en else []
        gone_a, gone_b = {x for x, _ in [*best[4], *also]}, {y for _, y in [*best[4], *also]}
        rows[i] = [x for x in rows[i] if x not in gone_a]
        columns[j] = [y for y in columns[j] if y not in gone_b]
        cut_rows.add(i)
        cut_columns.add(j)
        taken.add((i, j))
        del open_[i, j]
        for c in [c for c in seen if (c[0] == i or c[1] == j) and c not in taken]:
            if m := measure(*c):
                open_[c] = m
            else:
                open_.pop(c, None)
    return found


def _per_record(words, lists, common: dict[str, list[str]]):
    """The record's own part of the lexicon, and that of the common words."""
    own: dict[str, list[str]] = {}
    if words is not None:
        for w, v in zip(words, lists):
            own.setdefault(w, []).extend(v)

    def partners(w: str) -> list[str]:
        got = own.get(w, [])
        for k in _keys(w):
            if k in common:
                got = [*got, *common[k]]
        return got

    return partners if common else lambda w: own.get(w, ())


def _keys(word: str) -> list[str]:
    """Under which a word stands in the lexicon: a word that begins with the particle "and" is also looked up without it."""
    return [word, word[1:]] if word.startswith(AND) and len(word) > 3 else [word]


def _learn(light, common) -> Callable:
    """(_w, _v, _n): words together in joined sentences; with an empty partner, sentences with the word; with both empty,
    all joined pairs of sentences."""

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n: dict[tuple[str, str], int] = {}
            for _, ar, ars, en, ens, words, lists in batch.itertuples(index=False):
                for i, j, _c in blocks(list(ar), list(ars), list(en), list(ens), _per_record(words, lists, common.value), light.value):
                    a = {w for w, s in zip(ar, ars) if s == i}
                    b = {w for w, s in zip(en, ens) if s == j}
                    n["", ""] = n.get(("", ""), 0) + 1
                    for w in a:
                        n[w, ""] = n.get((w, ""), 0) + 1
                        for v in b:
                            n[w, v] = n.get((w, v), 0) + 1
                    for v in b:
                        n["", v] = n.get(("", v), 0) + 1
            yield pd.DataFrame([(w, v, c) for (w, v), c in n.items()], columns=["_w", "_v", "_n"])

    return learn


def _joined(light, common) -> Callable:
    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, ar, ars, en, ens, words, lists in batch.itertuples(index=False):
                for i, j, chain in blocks(list(ar), list(ars), list(en), list(ens), _per_record(words, lists, common.value), light.value):
                    out.append((key, i, j, len(chain)))
            yield pd.DataFrame(out, columns=["_id", "ar_sent", "en_sent", "points"])

    return joined


def _with_lexicon(tokens: DataFrame, lexicon: DataFrame, crowded: DataFrame) -> DataFrame:
    """Every record with its own part of the lexicon (_words, _lists): joined by word, gathered by record. Common words
    are left to the tasks, which have their part as a whole (_common)."""
    lists = lexicon.groupBy("_w").agg(F.collect_set("_v").alias("_list"))
    words = tokens.select("_id", F.explode(F.array_distinct("_ar")).alias("_word"))
    joined = F.col("_word").startswith(AND) & (F.length("_word") > 3)
    keys = F.when(joined, F.array("_word", F.substring(F.col("_word"), F.lit(2), F.length("_word")))).otherwise(F.array("_word"))
    own = F.broadcast(crowded.where("_side = 'a'").select("_w"))
    met = words.select("_id", "_word", F.explode(keys).alias("_w")).join(own, "_w", "left_anti").join(lists, "_w")
    own = met.groupBy("_id").agg(F.collect_list(F.struct("_word", "_list")).alias("_own"))
    return tokens.join(own, "_id", "left").select(*[c for c in tokens.columns], F.col("_own._word").alias("_words"), F.col("_own._list").alias("_lists"))


def _common(lexicon: DataFrame, crowded: DataFrame):
    """The common words' part of the lexicon, sent to all tasks: few words, and a partner of one is in many sentences."""
    rows = lexicon.join(F.broadcast(crowded.where("_side = 'a'").select("_w")), "_w").groupBy("_w").agg(F.collect_set("_v").alias("_list")).collect()
    return lexicon.sparkSession.sparkContext.broadcast({r._w: list(r._list) for r in rows})


def aligned(
    records: DataFrame, glossary: DataFrame, key: str = "rec_id", ar: str = "matn", en: str = "en", ar_term: str = "ar_term",
    en_term: str = "en_term", rounds: int = ROUNDS,
) -> DataFrame:
    """(key, ar_sent, en_sent, points) of all pairs of sentences that translate each other, in whole or in part.

    Each distinct pair of texts is aligned once, and its sentences go to all records that have it: copies neither cost
    nor count again. The glossary's single words give the first correspondences; every round aligns the sentences with
    the lexicon so far and takes from the joined sentences the pairs of words that keep company there. Words in more
    than CROWDED of the distinct texts weigh less (see blocks), and are learned only with partners they meet more often
    than by chance; there are fewer than 1 / CROWDED times the words of an average text, so that they and their
    partners are broadcast. The rest of the lexicon isn't: it meets the texts by a join on words.

    Null and blank texts have no sentences; a record without a counterpart gives no row; repeated keys must be reduced
    before. A text is worked on in one task; its cost grows with its pairs of sentences that share words.
    """
    wanted = records.where(F.col(key).isNotNull() & F.col(ar).rlike(f"[^{SPACE}]") & F.col(en).rlike(f"[^{SPACE}]"))
    digest = F.unhex(F.sha2(F.concat_ws(" ", F.length(ar).cast("string"), ar, en), 256))
    wanted = cut(wanted.select(F.col(key).alias("_id"), F.col(ar).alias("_a"), F.col(en).alias("_e"), digest.alias("_same")))
    texts = wanted.groupBy("_same").agg(F.min(F.struct("_id", "_a", "_e")).alias("_t")).select("_t.*")
    copies = wanted.select("_same", F.col("_id").alias(key)).join(wanted.groupBy("_same").agg(F.min("_id").alias("_id")), "_same").drop("_same")
    tokens = cut(texts.mapInPandas(_tokens, _TOKENS))
    total = tokens.count()
    side = lambda s, c: tokens.select(F.lit(s).alias("_side"), F.explode(F.array_distinct(c)).alias("_w"))
    often = side("a", "_ar").unionByName(side("e", "_en")).groupBy("_side", "_w").agg(F.count("*").alias("_texts"))
    crowded = cut(often.where(F.col("_texts") > CROWDED * (total + 1)))
    told = crowded.collect()
    light = tokens.sparkSession.sparkContext.broadcast(tuple({r._w: weight(r._texts, total) for r in told if r._side == s} for s in "ae"))
    terms = glossary.select(F.col(ar_term).alias("a"), F.col(en_term).alias("e")).where("a is not null and e is not null")

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = WordReader()
        for batch in batches:
            out = []
            for a, e in batch.itertuples(index=False):
                left, right = reader.words(a), reader.words(e)
                if len(left) == 1:
                    out.extend((py_without_lead(left[0]), v) for v in right)
            yield pd.DataFrame(out, columns=["_w", "_v"])

    known = terms.mapInPandas(entries, "_w string, _v string").distinct()
    lexicon = known
    for _ in range(rounds):
        seen = cut(_with_lexicon(tokens, lexicon, crowded).mapInPandas(_learn(light, _common(lexicon, crowded)), "_w string, _v string, _n bigint").groupBy("_w", "_v").agg(F.sum("_n").alias("_n")))
        both = seen.where("_w <> '' and _v <> ''").where(F.col("_n") >= TOGETHER)
        pairs = seen.where("_w = '' and _v = ''").agg(F.coalesce(F.max("_n"), F.lit(0))).scalar()
        left = seen.where("_v = ''").select("_w", F.col("_n").alias("_nw"))
        right = seen.where("_w = ''").select("_v", F.col("_n").alias("_nv"))
        flag = lambda s, c: F.broadcast(crowded.where(F.col("_side") == s).select(F.col("_w").alias(c), F.lit(True).alias(f"_often{c}")))
        met = both.join(left, "_w").join(right, "_v").join(flag("a", "_w"), "_w", "left").join(flag("e", "_v"), "_v", "left")
        n, n_w, n_v = (F.col(c).cast("double") for c in ("_n", "_nw", "_nv"))
        chance = n * pairs - n_w * n_v  # of words in most sentences; the square of the correlation is held against ASSOCIATED
        linked = (chance > 0) & (chance * chance >= ASSOCIATED * n_w * n_v * (pairs - n_w) * (pairs - n_v)) & (n_w < pairs) & (n_v < pairs)
        often = F.col("_often_w").isNotNull() | F.col("_often_v").isNotNull()
        kept = met.where((n * n >= ASSOCIATED * n_w * n_v) & (~often | linked))
        lexicon = cut(known.unionByName(kept.select("_w", "_v")).distinct())
    found = _with_lexicon(tokens, lexicon, crowded).mapInPandas(_joined(light, _common(lexicon, crowded)), "_id bigint, ar_sent int, en_sent int, points int")
    return found.join(copies, "_id").select(key, "ar_sent", "en_sent", "points")
