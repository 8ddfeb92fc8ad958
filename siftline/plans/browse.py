"""Queries of browsing, data checks, marked-up pages and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.functions import display as D
from siftline.functions import markup as M
from siftline.functions import words as W
from siftline.operators import asof, browse, evaluation
from siftline.plans import sql as S
from siftline.sources.tables import latest_records, table
from siftline.streaming import progress


def catalogue_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return browse.catalogue(table(spark, folder, "books")).drop("level")


def books_of_collections(spark: SparkSession, folder: str) -> DataFrame:
    """Books in display order with their declared and their real numbers of records."""
    real = latest_records(spark, folder, "collection", "book_number").groupBy("collection", "book_number").agg(F.count("*").alias("found"))
    order = browse.collection_order(F.col("collection"), ["safina", "mizan"])
    rows = table(spark, folder, "books").join(real, ["collection", "book_number"], "left")
    return rows.select("collection", "book_number", "english", "hadiths", F.coalesce("found", F.lit(0)).alias("found"), order.cast("int").alias("place"))


def doc_offsets(spark: SparkSession, folder: str) -> DataFrame:
    return browse.doc_offsets(table(spark, folder, "books"))


def topics(spark: SparkSession, folder: str) -> DataFrame:
    rows = browse.topics(table(spark, folder, "chapters"), latest_records(spark, folder, "collection", "book_number", "ch"))
    return rows.withColumn("title", browse.bare_title(F.col("ar")))


def topics_per_collection(spark: SparkSession, folder: str) -> DataFrame:
    return browse.topics(table(spark, folder, "chapters"), latest_records(spark, folder, "collection", "book_number", "ch")).groupBy("collection").agg(F.count("*").alias("topics"))


def topic_filter(spark: SparkSession, folder: str) -> DataFrame:
    keyed = browse.keyed_topics(browse.topics(table(spark, folder, "chapters"), latest_records(spark, folder, "collection", "book_number", "ch")), table(spark, folder, "books"))
    return browse.filter_topics(keyed, "The Market").select("collection", "book_number", "ch", "n", "hadiths")


def chapter_headings(spark: SparkSession, folder: str) -> DataFrame:
    rows = browse.headed(latest_records(spark, folder, "collection", "book_number", "pos", "ch"), table(spark, folder, "chapters"))
    return rows.select("rec_id", "collection", "book_number", "pos", "heading")


def book_page(spark: SparkSession, folder: str) -> DataFrame:
    """Every book's first page of forty records from its second chapter on: pages are keyed by place, not skipped to."""
    rows = latest_records(spark, folder, "collection", "book_number", "pos", "ch")
    start = browse.chapter_start(rows).where("ch = 1").select("collection", "book_number", "start")
    nth = F.row_number().over(Window.partitionBy("collection", "book_number").orderBy("pos", "rec_id"))
    return rows.join(start, ["collection", "book_number"]).where("pos >= start").withColumn("nth", nth).where(F.col("nth") <= browse.PAGE).select("collection", "book_number", "nth", "rec_id")


def record_by_link(spark: SparkSession, folder: str) -> DataFrame:
    """Records that documents refer to by link (a semi-join on the link)."""
    links = table(spark, folder, "documents").select("slug").where("slug is not null")
    return latest_records(spark, folder, "slug").join(links, "slug", "left_semi").select("rec_id", "slug")


def orphan_chapters(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters without any record (an anti-join)."""
    used = latest_records(spark, folder, "collection", "book_number", "ch").select("collection", "book_number", "ch").distinct()
    return table(spark, folder, "chapters").join(used, ["collection", "book_number", "ch"], "left_anti").select("chapter_id")


def records_without_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Records that no vector stands for (an anti-join)."""
    embedded = table(spark, folder, "vectors").select("rec_id").where("rec_id is not null")
    return latest_records(spark, folder, "rec_id").join(embedded, "rec_id", "left_anti").select("rec_id")


def integrity(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.violations(latest_records(spark, folder), table(spark, folder, "chapters"), table(spark, folder, "books"))


def sequence_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.sequence_gaps(latest_records(spark, folder, "collection", "book_number", "pos", "inbook"))


def collection_totals(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.totals(latest_records(spark, folder))


def asof_lesson(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the last one of its source added strictly before it."""
    docs = table(spark, folder, "documents").where("source is not null and added_at is not null").select("doc_id", "source", "added_at")
    found = asof.asof(docs, docs.select("source", "added_at", F.col("doc_id").alias("before_id")), ["source"], "added_at", ["before_id"])
    return found.select("doc_id", "before_id")


def _page(records: DataFrame) -> DataFrame:
    """One marked-up page per book, written from its records: what the extraction has to read back."""
    e = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lit = F.lit
    has = F.coalesce(F.col("narrator"), lit("")) != ""
    told = F.when(has, F.concat(lit(M.NARRATED), e("narrator"), lit("</div>"))).otherwise("")
    graded = F.coalesce("grade", "gradear").isNotNull()
    by = F.when(F.col("grader").isNotNull(), F.concat(lit(" ("), e("grader"), lit(")"))).otherwise("")
    grades = F.when(
        graded,
        F.concat(
            lit(M.ANNOTATION + "<table><tr><td class=english_grade>Grade:</td><td class=english_grade>"), e("grade"),
            F.when(F.col("grade").isNotNull(), by).otherwise(""), lit("</td><td class=arabic_grade>"), e("gradear"),
            F.when(F.col("grade").isNull(), by).otherwise(""), lit("</td></tr></table></div>"),
        ),
    ).otherwise("")
    arabic = F.concat(
        lit(M.ARABIC_START + ' arabic"><span class="arabic_sanad arabic">'), e("ar.sanad"),
        lit('</span><span class="arabic_text_details arabic">'), e("ar.matn"), lit("</span></div>"),
    )
    html = F.concat(
        D.fill(M.CONTAINER_WRITTEN, collection=F.col("collection"), id=F.col("rec_id")),
        lit("<a name="), F.coalesce(F.col("inbook").cast("string"), lit("x")), lit("></a>"), lit(M.ENGLISH_START), told, lit(M.DETAILS), lit("<p>"), e("en"), lit("</p></div></div>"),
        F.when((F.coalesce("ar.sanad", lit("")) != "") | (F.coalesce("ar.matn", lit("")) != ""), arabic).otherwise(""),
        lit(M.RECORD_END), grades, lit(M.REFERENCE_TABLE + '><tr><td><b>Reference</b></td><td>: <a href="/'), F.coalesce("slug", lit("")), lit('">'), e("ref"),
        lit("</a></td></tr><tr><td>In-book reference</td><td>: "), e("inbookref"), lit("</td></tr></table>"), lit(M.CONTAINER_END),
    )
    before = F.lag("ch", 1, -1).over(Window.partitionBy("collection", "book_number").orderBy("pos", "rec_id"))
    opened = F.when(F.col("ch") > before, F.concat(lit(M.CHAPTER + "<div class=echapno>("), (F.col("ch") + 1).cast("string"), lit(")</div>" + M.CLEAR))).otherwise("")
    pieces = records.withColumn("ch", F.coalesce("ch", lit(-1))).withColumn("html", F.concat(opened, html))
    listed = F.array_sort(F.collect_list(F.struct("pos", "rec_id", "html")))
    return pieces.groupBy("collection", "book_number").agg(F.array_join(F.transform(listed, lambda p: p["html"]), "\n").alias("html")).select(F.concat_ws("/", "collection", "book_number").alias("page_id"), "html")


def extracted_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records written as marked-up pages and extracted again."""
    got = M.records_of(_page(latest_records(spark, folder)))
    return got.select(F.col("container_id").cast("bigint").alias("rec_id"), "inbook", "slug", "ref", "inbookref", "narrator", "en", "ar.sanad", "ar.matn", "grade", "gradear", "grader")


def page_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What the reconciliation of pages with their extracted records reports, by level."""
    page = _page(latest_records(spark, folder))
    return M.reconcile(page, M.records_of(page)).groupBy("level").agg(F.count("*").alias("notes"))


def page_chapters(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters of the written pages, and how many records the as-of rule gives each."""
    page = _page(latest_records(spark, folder))
    counts = M.records_of(page).groupBy("page_id", "ch").agg(F.count("*").alias("records"))
    return M.chapters_of(page).select("page_id", "ch", "n").join(counts, ["page_id", "ch"], "left")


def progress_share(spark: SparkSession, folder: str) -> DataFrame:
    """Users as files, values as bytes: the furthest state of each, and the overall share of a plan of four mean values each."""
    events = table(spark, folder, "events").where("value is not null")
    files = progress.per_file(events.select("user_id", "value", (F.col("value") * 2).alias("total")), "user_id", "value", "total")
    plan = events.groupBy(F.col("user_id").alias("file")).agg((F.avg("value") * 4).alias("size"))
    told = progress.share(files.withColumnRenamed("user_id", "file"), plan, 1000.0)
    return told.select(F.round("loaded", 4).alias("loaded"), F.round("total", 4).alias("total"), F.round("share", 6).alias("share"))


def progress_told(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").where("value is not null")
    most = events.agg(F.max("value")).scalar()
    return progress.throttled(events.select("user_id", "event_id", (F.col("value") / most).alias("part")), "user_id", "event_id", "part").select("user_id", "event_id")


def download_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The whole stream of events as one reporter's of each user: kinds of events as files of a few MB."""
    events = table(spark, folder, "events").select("user_id", "ts", "event_id", "event_type", F.col("value") * 20000)
    first = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    loaded = F.coalesce(F.col("(value * 20000)"), F.lit(0.0))
    rows = events.select(
        F.col("user_id").alias("session"), F.col("ts").alias("at"), F.when(first == 1, "download").otherwise("progress").alias("status"),
        F.col("event_type").alias("file"), loaded.alias("loaded"), F.lit(4_000_000.0).alias("total"),
    )
    return progress.reported(rows).groupBy("session").agg(F.count("*").alias("lines"), F.count_if(F.col("line").endswith("is coming")).alias("starts"))


def slow_stages(spark: SparkSession, folder: str) -> DataFrame:
    """How often a user's silence counts as slow, and when setting up begins after the first large value."""
    events = table(spark, folder, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("value") > 50).alias("done"))
    found = progress.stages(events, "user_id", "ts", F.col("done"))
    init = F.max(F.when(F.col("stage") == "init", F.unix_millis("at")))
    return found.groupBy("user_id").agg(F.count_if(F.col("stage") == "slow").alias("slow"), init.alias("init_ms"))


def notes_shown(spark: SparkSession, folder: str) -> DataFrame:
    """The first twenty notes on places in books, and how many more there are."""
    rows = sequence_gaps(spark, folder)
    note = F.format_string("%s/%d #%d: %d after %d", "collection", "book_number", "pos", "inbook", "before")
    return evaluation.first_notes(rows.withColumn("note", note), "collection", "book_number", "pos", "inbook")


def doc_pointers(spark: SparkSession, folder: str) -> DataFrame:
    """Where every record stands: collection, book and place."""
    return browse.pointers(latest_records(spark, folder, "collection", "book_number", "pos"))


def topics_file(spark: SparkSession, folder: str) -> DataFrame:
    """The topics as one payload: how many there are, the collections, and a digest of the list."""
    rows = topics(spark, folder).select("collection", "book_number", "ch", "n", "ar", "en", "hadiths")
    payload = browse.topics_payload(rows, "2026-01-01")
    return payload.select("built", "count", F.array_join("collections", "|").alias("collections"), F.size("topics").alias("topics"))


def idle_gaps(spark: SparkSession, folder: str) -> DataFrame:
    found = progress.gaps(table(spark, folder, "events").select("user_id", "ts"), "user_id", "ts", 3600.0)
    return found.groupBy("user_id").agg(F.count("*").alias("silences"), F.round(F.sum("idle"), 3).alias("idle"))


QUERIES = {
    f.__name__: f
    for f in (
        catalogue_rollup, books_of_collections, doc_offsets, topics, topics_per_collection, topic_filter, chapter_headings, book_page, record_by_link,
        orphan_chapters, records_without_vectors, integrity, sequence_gaps, collection_totals, asof_lesson, extracted_records, page_checks, page_chapters,
        progress_share, progress_told, download_lines, slow_stages, notes_shown, doc_pointers, topics_file, idle_gaps,
    )
}

_R = S.records()
_BAB = browse.BAB
_TOPICS = f"""(SELECT c.collection, c.book_number, c.ch, coalesce(nullif(c.nar, 0), nullif(c.n, 0), c.ch + 1) AS n, c.ar, c.en, coalesce(k.h, 0) AS hadiths FROM chapters c
   LEFT JOIN (SELECT collection, book_number, ch, count(*) AS h FROM {_R} WHERE ch >= 0 GROUP BY ALL) k USING (collection, book_number, ch)
   WHERE length(regexp_replace(coalesce(c.ar, ''), '^{_BAB}\\s*', '')) > 2 OR length(coalesce(c.en, '')) > 2)"""
_LINE = lambda c: f"trim(regexp_replace(coalesce({c}, ''), {S.quote(W.SPACES)}, ' ', 'g'))"
_VISIBLE = lambda c: f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({c}, ''), {S.quote('[' + W.SPACE.replace(chr(10), '') + ']+')}, ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{{2,}}', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')".replace("{{2,}}", "{2,}")
_KEY = f"""array_to_string(list_filter(list_transform({S.pieces("lower(concat_ws(' ', t.ar, t.en, b.english, b.arabic, t.collection))")},
   lambda w: coalesce(nullif({S.normalize_arabic('w')}, ''), {S.normalize_english('w')})), lambda w: w <> ''), ' ')"""

ORACLES = {
    "catalogue_rollup": "SELECT collection, book_number, sum(hadiths)::BIGINT AS hadiths, sum(chapters)::BIGINT AS chapters, count(*) AS books FROM books GROUP BY ROLLUP (collection, book_number)",
    "books_of_collections": f"""SELECT b.collection, b.book_number, b.english, b.hadiths, coalesce(f.n, 0) AS found, CASE b.collection WHEN 'safina' THEN 1 WHEN 'mizan' THEN 2 ELSE 3 END AS place
        FROM books b LEFT JOIN (SELECT collection, book_number, count(*) AS n FROM {_R} GROUP BY ALL) f USING (collection, book_number)""",
    "doc_offsets": "SELECT collection, book_number, coalesce(sum(hadiths) OVER (ORDER BY collection, book_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_doc FROM books",
    "topics": f"SELECT *, regexp_replace(coalesce(ar, ''), '^{_BAB}\\s+', '') AS title FROM {_TOPICS}",
    "topics_per_collection": f"SELECT collection, count(*) AS topics FROM {_TOPICS} GROUP BY collection",
    "topic_filter": f"""SELECT collection, book_number, ch, n, hadiths FROM (SELECT t.*, {_KEY} AS key FROM {_TOPICS} t LEFT JOIN books b USING (collection, book_number)) WHERE contains(key, 'the market')""",
    "chapter_headings": f"""SELECT r.rec_id, r.collection, r.book_number, r.pos, CASE WHEN coalesce(r.ch <> r.before, true) AND r.ch >= 0 THEN coalesce(nullif(c.en, ''), nullif(c.ar, '')) END AS heading
        FROM (SELECT *, lag(ch, 1, -2) OVER (PARTITION BY collection, book_number ORDER BY pos, rec_id) AS before FROM {_R}) r
        LEFT JOIN chapters c ON c.collection = r.collection AND c.book_number = r.book_number AND c.ch = r.ch""",
    "book_page": f"""WITH r AS (SELECT * FROM {_R}), s AS (SELECT collection, book_number, min(pos) AS start FROM r WHERE ch = 1 GROUP BY ALL)
        SELECT collection, book_number, nth::INT AS nth, rec_id FROM (SELECT r.*, row_number() OVER (PARTITION BY collection, book_number ORDER BY pos, rec_id) AS nth
          FROM r JOIN s USING (collection, book_number) WHERE r.pos >= s.start) WHERE nth <= 40""",
    "record_by_link": f"SELECT rec_id, slug FROM {_R} r WHERE slug IN (SELECT slug FROM documents WHERE slug IS NOT NULL)",
    "orphan_chapters": f"SELECT chapter_id FROM chapters c WHERE NOT EXISTS (SELECT 1 FROM {_R} r WHERE r.collection = c.collection AND r.book_number = c.book_number AND r.ch = c.ch)",
    "records_without_vectors": f"SELECT rec_id FROM {S.records('rec_id')} WHERE rec_id NOT IN (SELECT rec_id FROM vectors WHERE rec_id IS NOT NULL)",
    "integrity": f"""WITH r AS (SELECT r.*, m.most FROM {_R} r LEFT JOIN (SELECT collection, book_number, max(ch) AS most FROM chapters GROUP BY ALL) m USING (collection, book_number)),
        c AS (SELECT count(*) FILTER (coalesce(ref, '') = '') AS a, count(*) FILTER (coalesce(slug, '') = '') AS b, count(*) FILTER (n IS NULL) AS c, count(*) FILTER (coalesce(inbookref, '') = '') AS d,
          count(*) FILTER (coalesce(slug, '') <> '' AND NOT coalesce(starts_with(slug, collection || ':'), false)) AS e, count(*) FILTER (ch < -1 OR ch > coalesce(most, -1)) AS f,
          count(*) FILTER (coalesce(ar.matn, '') = '' AND coalesce(ar.sanad, '') = '' AND coalesce(en, '') = '') AS g FROM r),
        l AS (SELECT coalesce(sum(n), 0)::BIGINT AS n FROM (SELECT count(*) - 1 AS n FROM r GROUP BY collection, coalesce(slug, ''))),
        k AS (SELECT b.*, coalesce(x.n, 0) AS records_, coalesce(y.n, 0) AS chapters_ FROM books b LEFT JOIN (SELECT collection, book_number, count(*) AS n FROM r GROUP BY ALL) x USING (collection, book_number)
          LEFT JOIN (SELECT collection, book_number, count(*) AS n FROM chapters GROUP BY ALL) y USING (collection, book_number)),
        b AS (SELECT count(*) FILTER (coalesce(english, '') = '') AS h, count(*) FILTER (coalesce(arabic, '') = '') AS i, count(*) FILTER (NOT coalesce(starts_with(source_file, collection || '/'), false)) AS j,
          count(*) FILTER (hadiths IS DISTINCT FROM records_) AS o, count(*) FILTER (chapters IS DISTINCT FROM chapters_) AS p FROM k)
        SELECT unnest(['no reference', 'no link', 'no number', 'no place in book', 'link of another collection', 'chapter out of range', 'no text at all', 'empty chapter', 'link of several records',
            'book without English name', 'book without Arabic name', 'file of another collection', 'declared records differ', 'declared chapters differ']) AS rule,
          unnest([c.a, c.b, c.c, c.d, c.e, c.f, c.g, (SELECT count(*) FROM chapters WHERE coalesce(en, '') = '' AND coalesce(ar, '') = ''), l.n, b.h, b.i, b.j, b.o, b.p]) AS violations FROM c, l, b""",
    "sequence_gaps": f"""SELECT collection, book_number, pos, inbook, before FROM (SELECT *, coalesce(last_value(inbook IGNORE NULLS) OVER (PARTITION BY collection, book_number ORDER BY pos, rec_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {_R}) WHERE inbook IS NOT NULL AND inbook <> before + 1""",
    "collection_totals": f"""SELECT collection, count(*) AS records, count(DISTINCT slug) AS links,
        count(*) FILTER (coalesce(en, '') = '') AS arabic_only, count(*) FILTER (coalesce(ar.matn, '') = '' AND coalesce(ar.sanad, '') = '') AS english_only,
        count(*) FILTER (coalesce(grade, '') <> '' OR coalesce(gradear, '') <> '') AS graded, count(*) FILTER (coalesce(narrator, '') <> '') AS narrated FROM {_R} GROUP BY collection""",
    "asof_lesson": """WITH d AS (SELECT doc_id, source, added_at FROM documents WHERE source IS NOT NULL AND added_at IS NOT NULL), m AS (SELECT source, added_at, max(doc_id) AS before_id FROM d GROUP BY ALL)
        SELECT d.doc_id, m.before_id FROM d ASOF LEFT JOIN m ON d.source = m.source AND d.added_at > m.added_at""",
    "extracted_records": f"""SELECT rec_id, inbook, CASE WHEN slug <> '' THEN slug END AS slug, CASE WHEN slug <> '' THEN {_LINE('ref')} END AS ref, {_VISIBLE('inbookref')} AS inbookref, nullif({_VISIBLE('narrator')}, '') AS narrator, {_VISIBLE('en')} AS en,
        {_LINE('ar.sanad')} AS sanad, {_LINE('ar.matn')} AS matn, nullif({_LINE('grade')}, '') AS grade, nullif({_LINE('gradear')}, '') AS gradear,
        CASE WHEN coalesce(grade, gradear) IS NOT NULL THEN grader END AS grader FROM {_R}""",
    "page_checks": f"""WITH r AS (SELECT *, {_LINE('ar.sanad')} AS sanad_, {_LINE('ar.matn')} AS matn_, {_VISIBLE('en')} AS en_ FROM {_R}),
        n AS (SELECT CASE WHEN en_ = '' AND sanad_ = '' AND matn_ = '' THEN 'error' WHEN en_ = '' OR (sanad_ = '' AND matn_ = '') THEN 'gap' END AS level FROM r
          UNION ALL SELECT CASE WHEN coalesce(slug, '') = '' THEN 'error' END FROM r
          UNION ALL SELECT 'error' FROM (SELECT count(*) FILTER (coalesce(narrator, '') <> '') AS a, count(*) FILTER ({_VISIBLE('narrator')} <> '') AS b,
            count(*) FILTER (coalesce(grade, gradear) IS NOT NULL) AS c, count(*) FILTER ({_LINE('grade')} <> '' OR {_LINE('gradear')} <> '') AS d FROM {_R} GROUP BY collection, book_number) WHERE a <> b
          UNION ALL SELECT 'error' FROM (SELECT count(*) FILTER (coalesce(grade, gradear) IS NOT NULL) AS c, count(*) FILTER ({_LINE('grade')} <> '' OR {_LINE('gradear')} <> '') AS d FROM {_R} GROUP BY collection, book_number) WHERE c <> d)
        SELECT level, count(*) AS notes FROM n WHERE level IS NOT NULL GROUP BY level""",
    "page_chapters": f"""WITH r AS (SELECT collection || '/' || book_number AS page_id, pos, rec_id, coalesce(ch, -1) AS ch FROM {_R}),
        o AS (SELECT *, ch > lag(ch, 1, -1) OVER (PARTITION BY page_id ORDER BY pos, rec_id) AS opens FROM r),
        c AS (SELECT *, sum(opens::INT) OVER (PARTITION BY page_id ORDER BY pos, rec_id ROWS UNBOUNDED PRECEDING) - 1 AS k FROM o)
        SELECT page_id, k::INT AS ch, max(CASE WHEN opens THEN ch + 1 END)::INT AS n, count(*) AS records FROM c WHERE k >= 0 GROUP BY page_id, k""",
    "download_lines": """WITH e AS (SELECT user_id AS session, ts, coalesce(value * 20000, 0) AS loaded, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS nth FROM events),
        l AS (SELECT session, list({s: epoch_us(ts) / 1e6, d: nth = 1, f: event_type, v: loaded} ORDER BY ts, CASE WHEN nth = 1 THEN 'download' ELSE 'progress' END, event_type, loaded) AS x FROM e GROUP BY session),
        r AS (SELECT session, list_reduce(x, lambda a, e: CASE WHEN e.d THEN {last: a.last, line: '', n: a.n + 1, c: a.c + 1}
            WHEN e.v < 4000000 AND e.s - a.last < 1 THEN a
            WHEN printf('%s: %.1f', e.f, e.v / 1048576) = a.line THEN {last: e.s, line: a.line, n: a.n, c: a.c}
            ELSE {last: e.s, line: printf('%s: %.1f', e.f, e.v / 1048576), n: a.n + 1, c: a.c} END, {last: 0.0::DOUBLE, line: '', n: 0::BIGINT, c: 0::BIGINT}) AS z FROM l)
        SELECT session, z.n AS lines, z.c AS starts FROM r""",
    "slow_stages": """WITH g AS (SELECT user_id, ts, lead(ts) OVER w AS until, bool_or(coalesce(value > 50, false)) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS done FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        i AS (SELECT *, (epoch_us(until) - epoch_us(ts)) / 1e6 AS idle FROM g), s AS (SELECT user_id, sum(floor(idle / 45))::BIGINT AS slow, min(ts) FILTER (done AND idle >= 4) AS first FROM i GROUP BY user_id)
        SELECT user_id, slow, epoch_us(first) // 1000 + 4000 AS init_ms FROM s WHERE slow > 0 OR first IS NOT NULL""",
    "notes_shown": f"""WITH g AS (SELECT *, row_number() OVER (ORDER BY collection, book_number, pos, inbook) AS nth FROM (SELECT *, coalesce(last_value(inbook IGNORE NULLS) OVER (PARTITION BY collection, book_number ORDER BY pos, rec_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {_R}) WHERE inbook IS NOT NULL AND inbook <> before + 1)
        SELECT nth::INT AS nth, collection || '/' || book_number || ' #' || pos || ': ' || inbook || ' after ' || before AS note FROM g WHERE nth <= 20
        UNION ALL SELECT 21, '… ' || (count(*) - 20) || ' more' FROM g HAVING count(*) > 20""",
    "doc_pointers": f"SELECT rec_id AS doc_id, collection, book_number AS book, pos FROM {_R}",
    "topics_file": f"SELECT '2026-01-01' AS built, count(*) AS count, string_agg(DISTINCT collection, '|' ORDER BY collection) AS collections, count(*)::INT AS topics FROM {_TOPICS}",
    "progress_share": """WITH f AS (SELECT user_id, max(value) AS l, max(value * 2) AS t FROM events WHERE value IS NOT NULL GROUP BY user_id),
        p AS (SELECT user_id, 4 * avg(value) AS size FROM events WHERE value IS NOT NULL GROUP BY user_id),
        t AS (SELECT sum(l) AS l, 1000 + sum(size) + sum(greatest(0, t - size)) AS t FROM f JOIN p USING (user_id))
        SELECT round(l, 4) AS loaded, round(t, 4) AS total, round(least(0.99, l / t), 6) AS share FROM t""",
    "progress_told": """WITH p AS (SELECT user_id, event_id, value / (SELECT max(value) FROM events) AS part FROM events WHERE value IS NOT NULL),
        l AS (SELECT user_id, list({id: event_id, part: part} ORDER BY event_id) AS x FROM p GROUP BY user_id),
        t AS (SELECT user_id, list_reduce(x, lambda a, e: CASE WHEN e.part - a.last >= 0.002 OR e.part >= 0.99 THEN {last: e.part, ids: list_append(a.ids, e.id)} ELSE a END, {last: -1.0::DOUBLE, ids: []::BIGINT[]}) AS z FROM l)
        SELECT user_id, unnest(z.ids) AS event_id FROM t""",
    "idle_gaps": """SELECT user_id, count(*) AS silences, round(sum(idle), 3) AS idle FROM (SELECT user_id, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts) AS idle FROM events)
        WHERE idle >= 3600 GROUP BY user_id""",
}
