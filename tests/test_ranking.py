import math

import pytest
from pyspark.sql import functions as F

from siftline.operators import asof, browse, evaluation, lexical, ranking, vectors
from siftline.plans import retrieval


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id bigint, text string")


def score(spark, questions, *texts, cutoff=1.0):
    d = docs(spark, *texts)
    posted = lexical.postings(d)
    lengths = lexical.doc_lengths(d, posted)
    average = lengths.agg(F.floor(F.avg("doc_len") + 0.5)).first()[0]
    parts = ranking.contributions(lexical.query_terms(asked(spark, *questions)), posted, lengths, lexical.vocabulary(posted, len(texts), cutoff), len(texts), average)
    return ranking.bm25(parts)


def test_stopwords_leave_the_topic(spark):
    rows = lexical.query_terms(asked(spark, "what did the Prophet say about anger?", "what is the")).collect()
    assert [r.term for r in rows if r.query_id == 0] == ["anger"]
    assert {r.grp for r in rows if r.query_id == 1} == {0, 1, 2}


def test_weights_and_groups(spark):
    rows = lexical.query_terms(asked(spark, "prayers prayers fasting")).orderBy("grp", "pos").collect()
    assert [(r.grp, r.pos, r.term, r.weight) for r in rows] == [(0, 0, "prayers", 0.5), (0, 1, "prayer", 0.5), (1, 0, "fasting", 1.0)]


def test_bm25_by_hand(spark):
    rows = score(spark, ["camel"], "camel camel river", "camel", "river stone").collect()
    idf = math.log(1 + (3 - 2 + 0.5) / (2 + 0.5))
    expected = {0: idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 2)), 1: idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 1 / 2))}
    assert {r.doc_id: pytest.approx(r.score) for r in rows} == expected


def test_equal_scores_go_by_id_and_empty_documents_count(spark):
    rows = score(spark, ["camel"], "", "camel", "camel", "camel").collect()
    assert [r.doc_id for r in sorted(rows, key=lambda r: r["rank"])] == [1, 2, 3]
    assert score(spark, ["nothing here"], "camel").count() == 0


def test_common_terms_leave_the_vocabulary(spark):
    posted = lexical.postings(docs(spark, "camel", "camel", "stone", "river", "palm"))
    assert {r.term for r in lexical.vocabulary(posted, 5, 0.2).collect()} == {"stone", "river", "palm"}
    figures = lexical.corpus_figures(docs(spark, "camel", "camel", "stone", "river", ""), posted).first()
    assert (figures.doc_count, figures.dropped_terms, figures.avg_doc_len) == (5, 1, 1)


def test_fusion_and_confidence(spark):
    lex = spark.createDataFrame([(0, 1, 5.0, ["a"], 1), (0, 2, 4.0, ["a"], 2)], "query_id bigint, doc_id bigint, score double, terms array<string>, rank int")
    sim = spark.createDataFrame([(0, 2, 0.9, 1), (0, 3, 0.8, 2)], "query_id bigint, doc_id bigint, score double, rank int")
    rows = ranking.fuse(lex, sim).orderBy("rank").collect()
    assert [(r.doc_id, r.lexical_rank, r.vector_rank) for r in rows] == [(2, 2, 1), (1, 1, 0), (3, 0, 2)]
    assert rows[0].score == pytest.approx(1 / 62 + 1 / 61)
    none = ranking.summary(asked(spark, "x", "y"), ranking.fuse(lex, sim), lex, sim).orderBy("query_id").collect()
    assert [r.confidence for r in none] == ["strong", "none"]


@pytest.mark.parametrize("l, v, said", [(1, 3, "strong"), (4, 1, "good"), (2, 0, "fair"), (0, 3, "fair"), (9, 0, "weak"), (None, None, "none")])
def test_confidence(spark, l, v, said):
    row = spark.createDataFrame([(l, v)], "l int, v int").select(ranking.confidence(F.col("l"), F.col("v")).alias("c")).first()
    assert row.c == said


def test_quantising_rounds_half_up(spark):
    row = spark.createDataFrame([([127.0, -2.5, 2.5, 0.4],), ([0.0, 0.0, 0.0, 0.0],)], "v array<double>").select(vectors.quantize(F.col("v")).alias("c")).collect()
    assert row[0].c.q == [127, -2, 3, 0] and row[0].c.scale == 1.0
    assert row[1].c.q == [0, 0, 0, 0] and row[1].c.scale == 1.0


def test_best_of_several_vectors_and_ties(spark):
    rows = spark.createDataFrame([(7, 1.0, [1, 0]), (7, 1.0, [0, 1]), (5, 1.0, [0, 1]), (9, 1.0, [1])], "doc_id bigint, scale float, q array<tinyint>")
    query = spark.createDataFrame([(0, [0.0, 1.0])], "query_id bigint, vector array<float>")
    got = vectors.similar(query, rows, 5, block=1).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in got] == [(5, 1.0), (7, 1.0)]
    assert vectors.similar(query.limit(0), rows).count() == 0


def test_windows_overlap_and_end(spark):
    words = [f"w{i}" for i in range(2000)]
    row = spark.createDataFrame([(" ".join(words), words, 2000), ("short", ["short"], 1)], "t string, w array<string>, n int")
    got = row.select(vectors.windows(F.col("t"), "passage", F.col("n"), F.col("w")).alias("p")).collect()
    assert len(got[0].p) == 4 and got[0].p[0].startswith("passage: w0 ")
    assert got[1].p == ["passage: short"]


def test_encoder_and_pooling(spark):
    texts = spark.createDataFrame([(1, "a b"), (2, None)], "id bigint, text string")
    rows = {r.id: r.vector for r in vectors.encode(texts, "id", "text", vectors.hashing_encoder(8)).collect()}
    assert sum(x * x for x in rows[1]) == pytest.approx(1.0) and set(rows[2]) == {0.0}
    tokens = spark.createDataFrame([("t", 1, [3.0, 0.0]), ("t", 1, [3.0, 8.0]), ("t", 0, [9.0, 9.0])], "text_id string, mask int, vector array<double>")
    assert vectors.mean_pool(tokens).first().vector == pytest.approx([0.6, 0.8])


def test_asof_is_strict(spark):
    left = spark.createDataFrame([(1, "k", 5), (2, "k", 3), (3, "k", 9), (4, "z", 1)], "id int, k string, at int")
    right = spark.createDataFrame([("k", 3, "a"), ("k", 5, "b")], "k string, at int, name string")
    got = {r.id: r.name for r in asof.asof(left, right, ["k"], "at", ["name"]).collect()}
    assert got == {1: "a", 2: None, 3: "b", 4: None}
    assert {r.id: r.name for r in asof.asof(left, right, ["k"], "at", ["name"], strict=False).collect()} == {1: "b", 2: "a", 3: "b", 4: None}


def test_asof_carries_over_ranges(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else "cold", i) for i in range(200)], "id int, k string, at int")
    right = spark.createDataFrame([("hot", 3, "a"), ("hot", 150, "b"), ("cold", 90, "c")], "k string, at int, name string")
    got = {r.id: r.name for r in asof.asof(left, right, ["k"], "at", ["name"]).collect()}
    assert got == {i: (("b" if i > 150 else "a" if i > 3 else None) if i % 3 else ("c" if i > 90 else None)) for i in range(200)}


def test_prefixed_length_decides(spark):
    rows = spark.createDataFrame([("x" * 890, ["x"] * 300, 2000), ("x" * 895, ["x"] * 300, 2000)], "t string, w array<string>, n int")
    got = rows.select(F.size(vectors.windows(F.col("t"), "passage", F.col("n"), F.col("w"))).alias("n")).collect()
    assert [r.n for r in got] == [1, 4]  # 890 + 9 characters fit, 895 + 9 don't


def test_rare_terms_go_by_first_place(spark):
    placed = lexical.first_places(docs(spark, "zebra camel tiger otter", "zebra camel tiger otter", "zebra camel"))
    rare = evaluation.rare_terms(placed, spark.createDataFrame([("zebra", 2), ("camel", 2), ("tiger", 2), ("otter", 2)], "term string, df bigint"))
    assert [(r.doc_id, r.term) for r in rare.orderBy("doc_id", "nth").collect()] == [(d, t) for d in (0, 1) for t in ("zebra", "camel", "tiger")]


def test_numbering_and_notes(spark):
    rows = evaluation.numbered(spark.createDataFrame([(x,) for x in (30, 10, 20, 50, 40)], "v int"), "v")
    assert {r.v: r.place for r in rows.collect()} == {10: 0, 20: 1, 30: 2, 40: 3, 50: 4}
    notes = spark.createDataFrame([(i, f"n{i}") for i in range(25)], "i int, note string")
    got = [r.note for r in evaluation.first_notes(notes, "i").orderBy("nth").collect()]
    assert got[:2] == ["n0", "n1"] and got[20] == "… 5 more" and len(got) == 21
    assert evaluation.first_notes(notes.limit(3), "i").count() == 3


def test_markers_of_the_corpus(spark):
    texts = spark.createDataFrame([("the camel crossed",), ("a river",)], "text string")
    markers = spark.createDataFrame([(1, "camel crossed", ["camel", "crossed"]), (2, "camel river", ["camel", "river"]), (3, "camel palm", ["camel", "palm"]), (4, "", [])], "query_id bigint, phrase string, words array<string>")
    assert {r.query_id for r in evaluation.present(texts, markers).collect()} == {1, 2}
    assert evaluation.present(texts, markers.limit(0)).count() == 0


def test_place_of_one_record(spark):
    hits = spark.createDataFrame([(0, 1, 3.0), (0, 2, 2.0), (0, 3, 2.0), (0, 4, 1.5), (0, 5, 1.0)], "query_id bigint, doc_id bigint, score double")
    wanted = spark.createDataFrame([(0, 5), (0, 3), (0, 9), (0, 1)], "query_id bigint, doc_id bigint")
    got = {r.doc_id: (r["rank"], r.of, list(r.above)) for r in ranking.places(wanted, hits).collect()}
    assert got == {5: (5, 5, [2, 3, 4]), 3: (3, 5, [1, 2]), 9: (0, 5, []), 1: (1, 5, [])}


def test_fast_ranking_is_the_explained_one(spark):
    texts = ["camel camel river", "camels", "river stone camel", "palm", "stone stone rivers"]
    posted = lexical.postings(docs(spark, *texts), lengths=True)
    terms = lexical.query_terms(asked(spark, "camels river", "stone palm camel"))
    known = lexical.vocabulary(posted, len(texts), 1.0)
    slow = ranking.bm25(ranking.contributions(terms, posted, None, known, len(texts), 2)).collect()
    fast = ranking.ranked(terms, posted, known, len(texts), 2).collect()
    key = lambda r: (r.query_id, r["rank"])
    assert [(r.query_id, r.doc_id, r.terms) for r in sorted(slow, key=key)] == [(r.query_id, r.doc_id, r.terms) for r in sorted(fast, key=key)]
    assert [r.score for r in sorted(fast, key=key)] == pytest.approx([r.score for r in sorted(slow, key=key)])
    plain = lexical.plain_terms(spark.createDataFrame([(0, ["camel", "camel", "stone"])], "query_id bigint, terms array<string>"))
    assert [(r.grp, r.term) for r in plain.orderBy("grp").collect()] == [(0, "camel"), (1, "stone")]


def test_metrics(spark):
    row = evaluation.metrics(spark.createDataFrame([(1,), (4,), (11,), (None,)], "rank int")).first()
    assert (row.hit_1, row.hit_5, row.hit_10, row.mrr_10) == (0.25, 0.5, 0.5, pytest.approx((1 + 0.25) / 4))


def test_generator():
    draw = evaluation.mulberry32(1)
    first = [next(draw) for _ in range(3)]
    assert all(0 <= x < 1 for x in first) and first[0] == pytest.approx(0.6270739405881613)


def test_topics_and_headings(spark):
    chapters = spark.createDataFrame([("c", 1, 0, 1, 3, "On rain", "باب", ""), ("c", 1, 1, None, 0, "", "باب", ""), ("c", 1, 2, 0, None, "", "باب المطر", "")], "collection string, book_number int, ch int, n int, nar int, en string, ar string, intro string")
    records = spark.createDataFrame([(1, "c", 1, 0, 0), (2, "c", 1, 1, 0), (3, "c", 1, 2, 2), (4, "c", 1, 3, -1)], "rec_id bigint, collection string, book_number int, pos int, ch int")
    rows = browse.topics(chapters, records).orderBy("ch").collect()
    assert [(r.ch, r.n, r.hadiths) for r in rows] == [(0, 3, 2), (2, 3, 1)]
    heads = {r.rec_id: r.heading for r in browse.headed(records, chapters).collect()}
    assert heads == {1: "On rain", 2: None, 3: "باب المطر", 4: None}
    assert browse.filter_topics(browse.keyed_topics(browse.topics(chapters, records), spark.createDataFrame([("c", 1, "Book", "")], "collection string, book_number int, english string, arabic string")), "RAIN").count() == 1


def test_postings_are_never_broadcast(spark, tmp_path):
    """Compressed files of a few MB hold postings that a driver has no room for."""
    lexical.postings(docs(spark, "camel river", "camel camel", "stone"), lengths=True).write.parquet(str(tmp_path / "posted"))
    posted = spark.read.parquet(str(tmp_path / "posted"))
    found = ranking.scores(lexical.query_terms(asked(spark, "camel", "stone")), posted, lexical.vocabulary(posted, 3, 1.0), 3, 2)
    assert "SortMergeJoin [term" in found._jdf.queryExecution().sparkPlan().toString()
    assert {(r.query_id, r.doc_id, r.tf) for r in found.collect()} == {(0, 0, 1), (0, 1, 2), (1, 2, 1)}


def test_words_of_records_are_never_broadcast(spark, tmp_path):
    """Spark counts 20 bytes for all words of a record, so the words of a whole corpus look like a small table."""
    folder = str(tmp_path)
    text = "struct<sanad:string,matn:string>"
    rows = [(1, 1, ("", ""), "patience in anger"), (1, 2, ("", ""), "a journey by camel"), (2, 1, ("", ""), "patience in times of anger"), (3, 1, ("", ""), "the camel"), (None, 1, ("", ""), "patience anger")]
    spark.createDataFrame(rows, f"rec_id bigint, scraped_at bigint, ar {text}, en string").write.parquet(f"{folder}/hadiths.parquet")
    spark.createDataFrame([(0, "how to keep patience in anger"), (1, "the camel of the river")], "item_id bigint, text string").write.parquet(f"{folder}/eval_items.parquet")
    spark.createDataFrame([("patience anger",), ("camel",), ("palm",)], "en_term string").write.parquet(f"{folder}/glossary.parquet")
    ranked = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (1, 2, 1), (1, 3, 11)], "query_id bigint, doc_id bigint, rank int")
    found = retrieval._answers(spark, folder, ranked)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [doc_id" in plan and "BroadcastHashJoin [doc_id" not in plan
    assert {(r.query_id, r["rank"]) for r in found.collect()} == {(0, 2), (1, None)}
