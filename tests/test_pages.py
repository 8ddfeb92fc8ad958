from siftline import session
from siftline.plans import browse, retrieval

RECORD = (
    "rec_id bigint, collection string, book_number int, pos int, slug string, ref string, inbook int, inbookref string, ch int, narrator string, en string, "
    "ar struct<sanad:string,matn:string>, grade string, gradear string, grader string, scraped_at timestamp"
)


def test_records_without_arabic_are_on_their_page(spark, tmp_path):
    row = lambda i, ch, en, ar: (i, "safina", 1, i, f"safina:{i}", f"Safina {i}", i, f"Book 1, {i}", ch, None, en, ar, None, None, None, None)
    rows = [row(1, 0, "It rained.", ("s", "m")), row(2, 0, "English only.", None), row(3, 1, "Next chapter.", None), row(4, 1, None, None)]
    spark.createDataFrame(rows, RECORD).write.parquet(f"{tmp_path}/hadiths.parquet")
    got = {r.rec_id: (r.en, r.sanad, r.matn) for r in browse.extracted_records(spark, str(tmp_path)).collect()}
    assert got == {1: ("It rained.", "s", "m"), 2: ("English only.", "", ""), 3: ("Next chapter.", "", ""), 4: ("", "", "")}
    assert {r.level: r.notes for r in browse.page_checks(spark, str(tmp_path)).collect()} == {"gap": 2, "error": 1}
    assert {(r.ch, r.n, r.records) for r in browse.page_chapters(spark, str(tmp_path)).collect()} == {(0, 1, 2), (1, 2, 2)}


def test_an_index_ends_with_its_scope(spark, tmp_path):
    kind = RECORD.replace("scraped_at", "n int, suffix string, scraped_at")
    row = (1, "safina", 1, 1, "safina:1", "Safina 1", 1, "Book 1, 1", 0, None, "rain river camel", ("s", "m"), None, None, None, 1, "", None)
    spark.createDataFrame([row], kind).write.parquet(f"{tmp_path}/hadiths.parquet")
    spark.createDataFrame([("safina", 1, 0, "rain", None)], "collection string, book_number int, ch int, en string, ar string").write.parquet(f"{tmp_path}/chapters.parquet")
    with session.scope():
        first = retrieval.Index.of(spark, str(tmp_path))
        assert retrieval.Index.of(spark, str(tmp_path)) is first and first.total == 1
    again = retrieval.Index.of(spark, str(tmp_path))
    assert again is not first and again.posted.count() == 3  # rain, river, camel; s and m are too short
