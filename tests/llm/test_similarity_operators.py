import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline import session
from siftline.llm import near_duplicates, neighbours, shared_spans


def runs(texts, span):
    seen: dict[tuple, set] = {}
    for f, i, t in texts:
        for s in range(len(t or "") - span + 1):
            seen.setdefault((f, t[s : s + span]), set()).add(i)
    out: dict[tuple, int] = {}
    for f, i, t in texts:
        marks = [0] * len(t or "")
        for s in range(len(t or "") - span + 1):
            if len(seen[f, t[s : s + span]]) > 1:
                marks[s : s + span] = [1] * span
        if any(marks):
            out[f, i] = sum(marks)
    return out


@pytest.mark.parametrize("span, phrase", [(12, 8), (12, 12), (20, 5)])
def test_shared_spans_agree_with_brute_force(spark, span, phrase):
    draw = random.Random(span)
    bank = ["".join(draw.choice("ab تّ😀") for _ in range(60)) for _ in range(6)]
    texts = []
    for i in range(60):
        parts = []
        for _ in range(draw.randint(0, 4)):
            if draw.random() < 0.5:
                source, at = draw.choice(bank), draw.randint(0, 40)
                parts.append(source[at : at + draw.randint(5, 30)])
            else:
                parts.append("".join(draw.choice("xyzuvw ") for _ in range(draw.randint(1, 20))))
        texts.append((draw.choice("fg"), i, "".join(parts)))
    texts += [("f", 100, None), ("f", 101, ""), ("f", 102, "q" * 300), ("f", 103, "q" * span), ("g", 104, "q" * 50)]
    rows = spark.createDataFrame([(f, i, t, 1) for f, i, t in texts], "fld string, rec_id bigint, text string, chars int")
    got = {(r.fld, r.rec_id): r.shared_chars for r in shared_spans.shared_spans(rows, "fld", "rec_id", "text", span, phrase).collect()}
    assert got == runs(texts, span)


def test_shared_spans_of_hot_copies_and_nothing(spark, monkeypatch):
    monkeypatch.setattr(shared_spans, "SHARD_PHRASES", 2)
    monkeypatch.setattr(shared_spans, "SHARD_TEXTS", 50)
    text = "".join(random.Random(1).choice("abcdefgh ") for _ in range(200))
    rows = spark.range(400).select(F.lit("f").alias("fld"), F.col("id").alias("rec_id"), F.lit(text).alias("text"))
    got = shared_spans.shared_spans(rows, "fld", "rec_id", "text")
    assert got.where("shared_chars = 200 and share = 1 and spans = 1").count() == 400
    assert shared_spans.shared_spans(rows.limit(0), "fld", "rec_id", "text").count() == 0
    assert shared_spans.shared_spans(rows.limit(1), "fld", "rec_id", "text").count() == 0


def jaccard_pairs(sets, least):
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9}


def test_near_duplicates_agree_with_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "SMALL", 6)
    draw, texts = random.Random(8), {}
    for group in range(40):
        base = [f"w{draw.randint(0, 150)}" for _ in range(25)]
        for _ in range(draw.randint(1, 5)):
            words = [w if draw.random() > 0.06 else f"w{draw.randint(0, 150)}" for w in base]
            draw.shuffle(words)
            texts[len(texts)] = " ".join(words)
    rows = [(i, t, None, "x") for i, t in texts.items()] + [(900, None, None, "x"), (901, "", "", "x"), (902, "w1 w2", "w3", "x"), (903, "w3 w2 w1", None, "x")]
    frame = spark.createDataFrame(rows, "rec_id bigint, a string, b string, union string")
    links, members = near_duplicates.similar_sets(near_duplicates.word_sets(frame, "rec_id", "a", "b"), 0.7)
    sets = {i: set(f"{a or ''} {b or ''}".split()) for i, a, b, _ in rows}
    true = jaccard_pairs({i: s for i, s in sets.items() if s}, 0.7)
    got = [tuple(r) for r in near_duplicates.pairs(links, members).collect()]
    assert len(got) == len(set(got)) and set(got) == true and (902, 903) in true
    groups = {r.rec_id: (r.group_id, r.links) for r in near_duplicates.groups(links, members).collect()}
    assert set(groups) == {i for i, s in sets.items() if s}
    for a, b in true:
        assert groups[a][0] == groups[b][0]
    assert all(g <= i for i, (g, _) in groups.items())


def test_near_duplicates_of_one_template(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "SMALL", 6)
    monkeypatch.setattr(near_duplicates, "LARGE", 40)
    monkeypatch.setattr(near_duplicates, "BLOCK", 16)
    draw, texts = random.Random(3), {}
    common = [f"common{i}" for i in range(18)]
    for i in range(300):
        texts[i] = " ".join(common + [f"own{i}x{j}" for j in range(12)])  # six tenths in common: similarity below one half
    for i in range(300, 360):  # near-duplicates among them
        words = texts[draw.randrange(300)].split()
        words[draw.randrange(18, 30)] = f"edit{i}"
        texts[i] = " ".join(words)
    rows = spark.createDataFrame([(i, t, None) for i, t in texts.items()], "rec_id bigint, matn string, en string")
    links, members = near_duplicates.similar_sets(near_duplicates.word_sets(rows, "rec_id", "matn", "en"), 0.7)
    got = {(r.rec_a, r.rec_b) for r in near_duplicates.pairs(links, members).collect()}
    assert got == jaccard_pairs({i: set(t.split()) for i, t in texts.items()}, 0.7)


def test_near_duplicates_in_parts_keep_the_disk_small(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "SMALL", 20)
    monkeypatch.setattr(near_duplicates, "BLOCK", 4)
    monkeypatch.setattr(near_duplicates, "SHARE", 3, raising=False)
    monkeypatch.setattr(near_duplicates, "FEWEST", 1, raising=False)
    draw, texts = random.Random(21), {}
    while len(texts) < 240:
        base = [f"w{draw.randint(0, 90)}" for _ in range(20)]
        for _ in range(draw.randint(1, 4)):
            texts[len(texts)] = " ".join([w if draw.random() > 0.06 else f"w{draw.randint(0, 90)}" for w in base])
    frame = spark.createDataFrame([(i, t, None) for i, t in texts.items()], "rec_id bigint, a string, b string")
    rows, cut = [], near_duplicates.cut

    def counted(*given):
        rows.append((table := cut(*given)).count())
        return table

    shuffles = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    monkeypatch.setattr(near_duplicates, "cut", counted)
    with session.scope():
        tables, files = len(session._LIVE), shuffles()
        links, members = near_duplicates.similar_sets(near_duplicates.word_sets(frame, "rec_id", "a", "b"), 0.7)
        for _ in range(50):  # they go in the background
            if shuffles() <= files:
                break
            time.sleep(0.2)
        assert shuffles() <= files
        kept = [entry[1] for entry in session._LIVE[tables:]]
        assert sum(spark.read.parquet(path).count() for path in kept) == members.count() + links.count()
        assert max(rows) <= 4 * len(texts)
        got = [tuple(r) for r in near_duplicates.pairs(links, members).collect()]
    assert len(got) == len(set(got)) and set(got) == jaccard_pairs({i: set(t.split()) for i, t in texts.items()}, 0.7)


def test_near_duplicates_of_hot_copies_and_nothing(spark):
    frame = spark.range(500).select(F.col("id").alias("rec_id"), F.when(F.col("id") % 3 == 0, "same words for a third of all").otherwise(F.concat(F.lit("own text of number n"), "id", F.lit(" m"), "id")).alias("t"))
    links, members = near_duplicates.similar_sets(near_duplicates.word_sets(frame, "rec_id", "t"), 0.8)
    assert members.groupBy("_class").count().agg(F.max("count")).first()[0] == 167
    assert links.count() == 0
    links, members = near_duplicates.similar_sets(near_duplicates.word_sets(frame.limit(0), "rec_id", "t"), 0.8)
    assert near_duplicates.pairs(links, members).count() == 0 and near_duplicates.groups(links, members).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (102, 101)], "_a bigint, _b bigint")
    got = {r._node: r._group for r in near_duplicates.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in (100, 101, 102)}


def frame_of(spark, matrix):
    return spark.createDataFrame([(i, 0.5, [int(x) for x in v], "x") for i, v in enumerate(matrix)], "vec_id bigint, scale float, q array<tinyint>, cosine string")


def test_neighbours_recall_and_copies(spark):
    draw = np.random.default_rng(9)
    centres = draw.normal(0, 40, (60, 24))
    matrix = np.clip(np.vstack([centres[i % 60] + draw.normal(0, 6, 24) for i in range(700)]), -127, 127).astype(int)
    matrix = np.vstack([matrix, np.repeat(matrix[:1], 300, axis=0)])
    frame = frame_of(spark, matrix)
    got = neighbours.nearest(neighbours.usable(frame, 24), k=5)
    lists = {}
    for r in got.orderBy("vec_id", "rank").collect():
        lists.setdefault(r.vec_id, []).append((r.other_id, r.cosine))
    unit = matrix / np.linalg.norm(matrix, axis=1)[:, None]
    cosines = unit @ unit.T
    np.fill_diagonal(cosines, -2)
    hits = total = 0
    for i in range(len(matrix)):
        assert len(lists[i]) == 5 and all(o != i for o, _ in lists[i])
        worst = np.sort(cosines[i])[-5]
        hits += sum(c >= worst - 1e-6 for _, c in lists[i])
        total += 5
    assert hits / total >= 0.9
    assert [o for o, _ in lists[0]] == [700, 701, 702, 703, 704]
    assert neighbours.similar_pairs(got, 0.999).where("vec_a >= vec_b").count() == 0


def test_neighbours_of_odd_input(spark):
    rows = spark.createDataFrame(
        [(1, 1.0, [3, 4]), (1, 1.0, [3, 4]), (2, 1.0, [0, 0]), (3, 1.0, None), (4, 1.0, [1]), (5, None, [1, 1]), (6, 0.0, [1, 1]), (7, -1.0, [-3, -4]), (None, 1.0, [1, 1]), (8, 2.0, [4, -3]), (9, 1.0, [None, 1])],
        "vec_id bigint, scale float, q array<tinyint>",
    )
    usable = neighbours.usable(rows, 2)
    assert {r._id for r in usable.collect()} == {1, 7, 8}
    got = {(r.vec_id, r.other_id): round(r.cosine, 6) for r in neighbours.nearest(usable).collect()}
    assert got[1, 7] == 1.0 and got[7, 1] == 1.0
    assert neighbours.nearest(usable.limit(0)).count() == 0
    assert neighbours.nearest(usable.where("_id = 8")).count() == 0
