import pytest
from pyspark.sql import functions as F

from siftline.functions import display as D
from siftline.functions import markup as M


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def ranges(rows):
    return [(r.start, r.end) for r in rows]


def test_highlighting(spark):
    at = lambda text, query: ranges(value(spark, D.highlight_ranges(F.lit(text), F.lit(query))))
    assert at("prayer and fasting", "prayer") == [(0, 6)]
    assert at("the Prayers, prayer", "prayers") == [(4, 11), (13, 19)]
    assert at("al-Salat", "salat") == [(3, 8)]
    assert at("😀 prayer", "prayer") == [(3, 9)]
    assert at("", "prayer") == [] and at("prayer", "") == []
    assert value(spark, D.mark(F.lit('a <b> "prayer"'), F.lit("prayer"))) == "a &lt;b&gt; &quot;<mark>prayer</mark>&quot;"


def test_ranges_merge(spark):
    given = F.expr("array(struct(9 AS start, 12 AS `end`), struct(0 AS start, 4 AS `end`), struct(4 AS start, 6 AS `end`), struct(1 AS start, 2 AS `end`))")
    assert ranges(value(spark, D.merge_ranges(given))) == [(0, 6), (9, 12)]
    assert value(spark, D.merge_ranges(F.array().cast(D.RANGES))) == []


def test_segments(spark):
    ar = F.struct(F.lit("chain {q1}").alias("sanad"), F.lit("one {two} three { stray").alias("matn"))
    assert [(s.kind, s.text) for s in value(spark, D.segments(ar))] == [("sanad", "chain"), ("quran", "{q1}"), ("matn", "one"), ("quran", "{two}"), ("matn", "three { stray")]
    assert value(spark, D.readable(F.struct(F.lit(" s ").alias("sanad"), F.lit("").alias("matn")))) == "s"
    odd = F.struct(F.lit("\n{q}\u00a0").alias("sanad"), F.lit("\u2003m\ufeff").alias("matn"))
    assert [(s.kind, s.text) for s in value(spark, D.segments(odd))] == [("quran", "{q}"), ("matn", "m")] and value(spark, D.readable(odd)) == "m"


def test_colours_and_beginnings(spark):
    ar = F.struct(F.lit("chain").alias("sanad"), F.lit("rain {two}").alias("matn"))
    assert value(spark, D.coloured(ar, F.lit("rain"), "big")) == (
        '<p class="arabic big" dir="rtl" lang="ar"><span class="ar-sanad">chain</span> <span class="ar-matn"><mark>rain</mark></span> <span class="ar-quran">{two}</span></p>'
    )
    none = F.struct(F.lit(None).cast("string").alias("sanad"), F.lit("").alias("matn"))
    assert value(spark, D.coloured(none, F.lit("rain"))) == ""
    assert value(spark, D.text_of(ar, F.lit("en"))) == "rain {two} chain en" and value(spark, D.snippet(ar, F.lit("a\n b"), 14)) == "rain {two} | a"


def test_labels(spark):
    assert value(spark, D.eastern_digits(F.lit(105))) == "١٠٥"
    assert value(spark, D.num(F.lit(1234567), "ar")) == "١٬٢٣٤٬٥٦٧" and value(spark, D.num(F.lit(1234567), "en")) == "1,234,567"
    assert value(spark, D.size_text(F.lit(1048576 * 2))) == "2 MB" and value(spark, D.size_text(F.lit(2_500_000), "ar")) == "٣ م.ب"
    assert value(spark, D.percent_text(F.lit(0.125))) == "13%" and value(spark, D.percent_text(F.lit(1.0), "ar")) == "١٠٠٪"
    assert value(spark, D.fill("{n} of {m} {x}", n=F.lit(3), m=F.lit("9"))) == "3 of 9 {x}"
    assert value(spark, D.why(F.lit(1), F.lit(0), F.array(F.lit("a"), F.lit("a"), F.lit("b")))) == "words: a, b"
    assert value(spark, D.pick(F.lit(""), F.lit("en"), "ar")) == "en"
    assert value(spark, D.chips(F.lit("s"), F.lit(None).cast("string"), F.lit(""), F.lit("ch"), F.lit(None).cast("string"))) == ["s", "ch"]


@pytest.mark.parametrize(
    "html, shown",
    [
        ("<p>a<br>b</p> c", "a\nb\nc"),
        ("x &amp;lt; &#1590; &#x41;&nbsp;y", "x &lt; ض A y"),
        ("<b>bold</b>\n\n\n t ", "bold\nt"),
        (None, ""),
    ],
)
def test_visible_text(spark, html, shown):
    got = spark.createDataFrame([(html,)], "h string").select(M.visible(F.col("h")).alias("v"), M.one_line(F.col("h")).alias("l")).first()
    assert got.v == shown and got.l == " ".join(shown.split())


def test_slices(spark):
    cut = lambda html, ends: value(spark, M.slice_between(F.lit(html), "<a>", ends))
    assert cut("x<a>y</a>z<b>", ["<b>", "</a>"]) == "y"
    assert cut("x<a>yz", ["</a>"]) == "yz"
    assert cut("nothing", ["</a>"]) == ""


OPEN = M.CONTAINER_WRITTEN.replace("{collection}", "safina")
PAGE = (
    f"{M.CHAPTER}<div class=echapno>(1)</div><div class=englishchapter>Chapter: On rain</div>"
    f'<div class="arabicchapter arabic">باب المطر</div>{M.CLEAR}<div class="arabic achapintro aconly">مقدمة</div>'
    f"{OPEN.replace('{id}', '7')}<a name=3></a>{M.ENGLISH_START}{M.NARRATED}By A</div>"
    f"""{M.DETAILS}<p>It rained.</p></div></div>{M.ARABIC_START}"><span class="arabic_sanad">عن &#1593;</span>"""
    f"<span class=arabic_text_details>مطر</span><span class=arabic_sanad> </span></div>{M.RECORD_END}"
    f"{M.ANNOTATION}<table><td class=english_grade>Grade:</td><td class=english_grade>Good (Zayd)</td></table></div>"
    f'{M.REFERENCE_TABLE}><tr><td><b>Reference</b></td><td>: <a href="/safina:12b">Safina 12b</a></td><td>In-book reference</td><td>: Book 1, 3</td></table>'
    f'{M.CONTAINER_END}{OPEN.replace("{id}", "8")}{M.ARABIC_START}">bare <b>block</b>'
)


def test_page(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, ""), (3, None)], "page_id int, html string")
    rows = M.records_of(pages).orderBy("pos").collect()
    one, two = rows
    assert (one.slug, one.ref, one.n, one.suffix, one.inbook, one.inbookref, one.ch) == ("safina:12b", "Safina 12b", 12, "b", 3, "Book 1, 3", 0)
    assert (one.narrator, one.en, one.ar.sanad, one.ar.matn, one.grade, one.grader) == ("By A", "It rained.", "عن ع", "مطر", "Good", "Zayd")
    assert (two.narrator, two.ar.sanad, two.slug, two.grade, two.ch) == (None, "", None, None, 0)
    assert two.ar.matn.endswith("bare block")
    chapter = M.chapters_of(pages).first()
    assert (chapter.n, chapter.nar, chapter.en, chapter.ar, chapter.intro) == (1, None, "On rain", "باب المطر", "مقدمة")
    levels = {(r.level, r.message) for r in M.reconcile(pages, M.records_of(pages)).collect()}
    assert ("error", "#2: link missing") in levels and not any("extracted" in m for _, m in levels)
    said = pages.where("page_id = 1").select("page_id", F.concat("html", F.lit("var collection = 'mizan' var bookID = '4' <b>9</b> " + M.DECLARED.split(" ")[-1])).alias("html"), F.lit("safina").alias("collection"), F.lit(3).alias("book_number"))
    notes = {(r.level, r.message) for r in M.reconcile(said, M.records_of(said)).collect()}
    assert {("error", "the collection in the page is mizan"), ("error", "the book in the page is 4"), ("warning", "2 records found where 9 are declared")} <= notes
