import pytest
from pyspark.sql import functions as F

from siftline.engine import Engine
from siftline.operators import vectors


@pytest.fixture(scope="module")
def engine(spark):
    rows = [
        (1, "c", 1, 0, 0, "c:1", "Narrated A:", "The camel crossed the river at dawn.", ("عن زيد", "عبر الجمل النهر")),
        (2, "c", 1, 1, 0, None, None, "A merchant weighed the salt.", ("", "وزن التاجر الملح")),
        (3, "c", 1, 2, 1, "c:3", None, "The river rose after the rain.", None),
        (4, "c", 2, 0, -1, "c:4", None, None, ("", "الصلاة في السوق")),
        (5, "c", 2, 1, -1, "c:5", None, "bread oven flour", None),
        (6, "c", 2, 2, -1, "c:6", None, "palm shade garden", None),
    ]
    kind = "rec_id bigint, collection string, book_number int, pos int, ch int, slug string, narrator string, en string, ar struct<sanad:string,matn:string>"
    records = spark.createDataFrame(rows, kind)
    chapters = spark.createDataFrame([("c", 1, 0, 1, 1, "On travel", "باب السفر"), ("c", 1, 1, 2, 2, "On weather", "باب المطر")], "collection string, book_number int, ch int, n int, nar int, en string, ar string")
    books = spark.createDataFrame([("c", 1, "First", "الأول", 3, 2), ("c", 2, "Second", "الثاني", 3, 0)], "collection string, book_number int, english string, arabic string, hadiths int, chapters int")
    encoder = vectors.hashing_encoder(32)
    coded = records.where("en is not null").select(F.col("rec_id"), F.lower(F.regexp_replace("en", "[.]", "")).alias("t"))
    held = vectors.encode(coded, "rec_id", "t", encoder).select(F.col("rec_id").alias("doc_id"), vectors.quantize(F.col("vector")).alias("c")).select("doc_id", "c.scale", "c.q")
    return Engine(spark, records, chapters, books, held, encoder, cutoff=0.5)


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id bigint, text string")


def test_ask(spark, engine):
    got = engine.ask(asked(spark, "where did the camel cross the river", "الصلاه", "xy", "nothing known zzz"), site="/")
    answers = {r.query_id: r for r in got.results.where("answer").collect()}
    assert answers[0].rec_id == 1 and answers[0].book == "First" and answers[0].chapter == "On travel" and answers[0].url == "/c:1"
    assert 4 in {r.rec_id for r in got.results.where("query_id = 1 and rank <= 2").collect()} and answers[0].why.startswith("both: ") and "camel" in answers[0].highlight
    said = {r.query_id: r for r in got.summary.collect()}
    assert set(said) == {0, 1, 3} and said[0].confidence == "strong" and not got.semantic_failed


def test_words_answer_when_the_encoder_fails(spark, engine):
    def broken(texts):
        raise RuntimeError("no model")

    heard = []
    poor = Engine(spark, engine.records, engine.chapters, engine.books, engine.vectors, broken, 0.5, heard.append)
    got = poor.search(asked(spark, "camel river"))
    assert got.semantic_failed and heard and got.results.where("rank = 1").first().doc_id == 1
    plain = Engine(spark, engine.records, engine.chapters, engine.books, cutoff=0.5).search(asked(spark, "camel"))
    assert not plain.semantic_failed and plain.results.count() == 1 and plain.summary.first().confidence == "fair"


def test_browsing(engine):
    assert [r.heading for r in engine.read("c", 1).collect()] == ["On travel", None, "On weather"]
    assert [r.rec_id for r in engine.read("c", 1, 1).collect()] == [3]
    assert engine.topics("TRAVEL").count() == 1 and engine.topics().count() == 2
    assert engine.record(3).first().slug == "c:3" and engine.by_link("c:1").first().rec_id == 1
