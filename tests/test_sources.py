import gzip
import json
from pathlib import Path

import pytest

from siftline import session
from siftline.sources import codec, tables


def test_word_format_round_trip():
    terms = [("ab", [0, 2, 300], [1, 200, 3]), ("ماء", [1], [2])]
    data = codec.encode_words([3, 0, 500], 139.6, terms)
    lengths, average, read = codec.decode_words(gzip.compress(data))
    assert (lengths, average, list(read)) == ([3, 0, 500], 140, terms)
    assert data == codec.encode_words([3, 0, 500], 139.6, terms)
    with pytest.raises(ValueError):
        codec.decode_words(b"NOPE\x01")
    with pytest.raises(ValueError):
        codec.decode_words(b"HIL1\x02")


def test_vector_format_round_trip(spark, tmp_path):
    rows = [(0, 0.5, [1, -127, 3]), (0, 1.0, [0, 0, 0]), (7, 0.25, [5, 6, 7])]
    data = codec.encode_vectors(8, 3, rows)
    assert codec.decode_vectors(data) == (8, 3, rows)
    (tmp_path / "v.bin").write_bytes(data)
    got = codec.read_vectors(spark, str(tmp_path / "v.bin")).orderBy("vec_id").collect()
    assert [(r.doc_id, r.scale, r.q) for r in got] == rows


def test_words_from_tables(spark, tmp_path):
    posted = spark.createDataFrame([("b", 1, 2), ("a", 0, 1), ("a", 1, 3)], "term string, doc_id bigint, tf bigint")
    lengths = spark.createDataFrame([(1, 5), (0, 1)], "doc_id bigint, doc_len bigint")
    (tmp_path / "w.bin").write_bytes(codec.export_words(lengths, posted, 3))
    again, sizes = codec.read_words(spark, str(tmp_path / "w.bin"))
    assert sorted(map(tuple, again.collect())) == [("a", 0, 1), ("a", 1, 3), ("b", 1, 2)]
    assert sorted(map(tuple, sizes.collect())) == [(0, 1), (1, 5)]


def test_pages_and_books(spark, tmp_path):
    (tmp_path / "safina_12.txt").write_bytes("\ufeffa\r\nb".encode())
    (tmp_path / "other.txt").write_text("x")
    rows = {r.book_number: r.html for r in tables.pages(spark, f"{tmp_path}/*.txt").collect()}
    assert rows == {12: "a\nb", 0: "x"}
    book = {"collection": "c", "book": {"number": 2, "english": "E", "arabic": ""}, "chapters": [{"n": 1, "nAr": None, "en": "One", "ar": "باب", "intro": ""}],
            "hadiths": [{"n": None, "suffix": "", "ch": 0, "en": "x", "ar": {"sanad": "", "matn": "م"}}, {"ch": -1, "en": "y"}]}
    (tmp_path / "2.json").write_text(json.dumps(book))
    (tmp_path / "3.json.gz").write_bytes(gzip.compress(json.dumps(book | {"collection": "d"}).encode()))
    got = tables.book_records(tables.book_files(spark, f"{tmp_path}/*.json*")).orderBy("collection", "pos").collect()
    assert [(r.collection, r.pos, r.chapter_en) for r in got] == [("c", 0, "One"), ("c", 1, None), ("d", 0, "One"), ("d", 1, None)]
    tables.write_books(tables.book_records(tables.book_files(spark, f"{tmp_path}/2.json")), f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").where("collection = 'c' and book_number = 2").count() == 2


def test_catalogue_and_manifest(spark, tmp_path):
    (tmp_path / "catalog.json").write_text(json.dumps({"collections": [{"id": "c", "books": [{"number": 1, "english": "E", "arabic": "", "hadiths": 3, "chapters": 2, "file": "f"}]}]}))
    assert tables.catalogue(spark, f"{tmp_path}/catalog.json").first().hadiths == 3
    tables.merge_manifest(f"{tmp_path}/m.json", words={"n": 1})
    assert tables.merge_manifest(f"{tmp_path}/m.json", vectors=2) == {"words": {"n": 1}, "vectors": 2}


def test_tables_end_with_their_scope(spark):
    with session.scope():
        kept = session.cut(spark.range(3))
        path = kept.inputFiles()[0]
        assert kept.count() == 3
    assert not Path(path.removeprefix("file://")).exists()


def test_books_are_read_by_folder_and_catalogue_comes_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 1)], "rec_id bigint, collection string, book_number int")
    tables.write_books(rows, str(tmp_path / "books"), compression="gzip")
    assert [r.rec_id for r in tables.read_book(spark, str(tmp_path / "books"), [("a", 2)]).collect()] == [2]
    assert {r.rec_id for r in tables.read_book(spark, str(tmp_path / "books"), rows.where("book_number = 1")).collect()} == {1, 3}
    books = spark.createDataFrame([("a", 1, "One", "ا", 5, 2, "a/1"), ("a", 2, "Two", None, 3, 0, "a/2")], "collection string, book_number int, english string, arabic string, hadiths int, chapters int, source_file string")
    tables.write_catalogue(books, str(tmp_path / "catalogue"))
    got = tables.catalogue(spark, str(tmp_path / "catalogue")).orderBy("book_number").collect()
    assert [(r.collection, r.book_number, r.english, r.hadiths, r.file) for r in got] == [("a", 1, "One", 5, "a/1"), ("a", 2, "Two", 3, "a/2")]
