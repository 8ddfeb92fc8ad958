"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import display as D
from siftline.functions import markup as M
from siftline.functions import words as W
from siftline.operators import lexical, ranges
from siftline.plans import sql as S
from siftline.sources.tables import latest_records, table


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "hadiths")
    return rows.select(F.explode(W.split_words(F.concat_ws(" ", "ar.matn", "ar.sanad", "en", "narrator"))).alias("raw")).distinct()


_PIECES = f"(SELECT DISTINCT unnest({S.pieces('concat_ws($$ $$, ar.matn, ar.sanad, en, narrator)')}) AS raw FROM hadiths)"


def split_words(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.size(W.split_words(F.coalesce("text", F.lit("")))).alias("words"))


def normalize_words(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder).select("raw", W.strip_marks(F.col("raw")).alias("bare"), W.is_arabic(F.col("raw")).alias("arabic"), W.normalize(F.col("raw")).alias("word"))


def word_variants(spark: SparkSession, folder: str) -> DataFrame:
    words = _pieces(spark, folder).select("raw", W.normalize(F.col("raw")).alias("word")).where("length(word) >= 2")
    spelt = F.filter(W.variants(F.col("raw"), F.col("word")), lambda v: F.length(v) >= 2)
    return words.select("raw", "word", F.array_join(spelt, "|").alias("variants"))


def unique_terms(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "chapters").select("chapter_id", F.concat_ws(" ", "ar", "en").alias("t"))
    kept = F.filter(W.unique_terms(F.col("t")), lambda t: ~W.is_stopword(t))
    return rows.select("chapter_id", F.size(W.terms(F.col("t"))).alias("terms"), F.array_join(F.array_sort(kept), "|").alias("kept"))


def query_terms(spark: SparkSession, folder: str) -> DataFrame:
    terms = lexical.query_terms(table(spark, folder, "eval_items"), "item_id", "text")
    return terms.withColumn("weight", F.round("weight", 6))


def document_text(spark: SparkSession, folder: str) -> DataFrame:
    docs = lexical.document_text(latest_records(spark, folder, *lexical.FIELDS), table(spark, folder, "chapters"))
    return docs.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").alias("chars"))


def topic_keys(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "chapters")
    return rows.select("chapter_id", D.topic_key(F.concat_ws(" ", "ar", "en")).alias("key"), D.flat(F.coalesce("ar", F.lit(""))).alias("flat"))


def content_words(spark: SparkSession, folder: str) -> DataFrame:
    rows = latest_records(spark, folder, "en")
    return rows.select("rec_id", F.array_join(F.array_sort(D.content_words(F.coalesce("en", F.lit("")))), "|").alias("words"))


def passages(spark: SparkSession, folder: str) -> DataFrame:
    titles = table(spark, folder, "chapters").select("collection", "book_number", "ch", F.col("ar").alias("_ca"), F.col("en").alias("_ce"))
    rows = latest_records(spark, folder, "collection", "book_number", "ch", "ar", "en").join(titles, ["collection", "book_number", "ch"], "left")
    text = D.passage(F.col("ar"), F.col("en"), F.col("_ca"), F.col("_ce"))
    return rows.select("rec_id", F.md5(text).alias("passage_md5"), F.md5(D.readable(F.col("ar"))).alias("readable_md5"))


def record_cards(spark: SparkSession, folder: str) -> DataFrame:
    """What a result shows of a record besides its text."""
    titles = table(spark, folder, "chapters").select("collection", "book_number", "ch", F.col("ar").alias("_ca"), F.col("en").alias("_ce"))
    books = table(spark, folder, "books").select("collection", "book_number", "english", "arabic")
    rows = latest_records(spark, folder).join(titles, ["collection", "book_number", "ch"], "left").join(books, ["collection", "book_number"], "left")
    c = F.col
    return rows.select(
        "rec_id", D.pick(c("arabic"), c("english"), "ar").alias("book_ar"), D.pick(c("arabic"), c("english"), "en").alias("book_en"),
        F.when(F.coalesce("slug", F.lit("")) != "", F.concat(F.lit("/"), "slug")).alias("url"),
        F.array_join(D.chips(c("slug"), c("ref"), c("inbookref"), D.pick(c("_ca"), c("_ce"), "en"), D.pick(c("gradear"), c("grade"), "en")), " | ").alias("chips"),
        D.escape(F.coalesce("en", F.lit(""))).alias("en_html"), D.eastern_digits(c("pos")).alias("pos_text"),
    )


def segments(spark: SparkSession, folder: str) -> DataFrame:
    rows = latest_records(spark, folder, "ar").select("rec_id", F.posexplode(D.segments(F.col("ar"))).alias("at", "s"))
    return rows.select("rec_id", "at", "s.kind", "s.text")


def quoted_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The quotes of every record: the segments that SQL can express."""
    rows = latest_records(spark, folder, "ar").select("rec_id", F.explode(D.segments(F.col("ar"))).alias("s")).where("s.kind = 'quran'")
    return rows.groupBy("rec_id").agg(F.count("*").alias("quotes"), F.sum(F.length("s.text")).alias("chars"))


def highlights(spark: SparkSession, folder: str) -> DataFrame:
    """Where a record shows the words of its chapter's title, and the marked text."""
    titles = table(spark, folder, "chapters").select("collection", "book_number", "ch", F.concat_ws(" ", "ar", "en").alias("q"))
    rows = latest_records(spark, folder, "collection", "book_number", "ch", "ar", "en").join(titles, ["collection", "book_number", "ch"])
    return rows.select("rec_id", D.highlight_ranges(F.col("en"), F.col("q")).alias("ranges"), D.mark(F.col("ar.matn"), F.col("q")).alias("html"))


def merged_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Days covered by each user's events, every event covering twenty minutes, as joined ranges in seconds."""
    events = table(spark, folder, "events").select("user_id", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '2020-01-01 00:00:00', ts)").cast("int").alias("s"))
    return ranges.merged(events.select("user_id", F.col("s").alias("start"), (F.col("s") + 1200).alias("end")), "user_id")


def coloured(spark: SparkSession, folder: str) -> DataFrame:
    """The Arabic text of every record in coloured segments, with the words of its chapter's title marked."""
    titles = table(spark, folder, "chapters").select("collection", "book_number", "ch", F.concat_ws(" ", "ar", "en").alias("q"))
    rows = latest_records(spark, folder, "collection", "book_number", "ch", "ar").join(titles, ["collection", "book_number", "ch"])
    html = D.coloured(F.col("ar"), F.col("q"))
    return rows.select("rec_id", F.size(F.regexp_extract_all(html, F.lit("<span"), F.lit(0))).alias("spans"), F.md5(F.regexp_replace(html, "</?mark>", "")).alias("html_md5"))


def labels(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers, sizes and shares in both languages, beginnings of texts."""
    rows = latest_records(spark, folder, "ar", "en")
    c = F.col("rec_id") * 977
    return rows.select(
        "rec_id", D.num(c, "en").alias("num_en"), D.num(c, "ar").alias("num_ar"), D.size_text(c * 1000).alias("size_en"), D.size_text(c * 1000, "ar").alias("size_ar"),
        D.percent_text(1 / (F.col("rec_id") + 1)).alias("part_en"), D.percent_text(1 / (F.col("rec_id") + 1), "ar").alias("part_ar"),
        F.md5(D.text_of(F.col("ar"), F.col("en"))).alias("text_md5"), D.snippet(F.col("ar"), F.col("en")).alias("snippet"),
    )


def visible_text(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as visible text, and the first paragraph between markers."""
    rows = table(spark, folder, "documents").where("text is not null")
    return rows.select("doc_id", F.md5(M.visible(F.col("text"))).alias("text_md5"), F.md5(M.one_line(F.col("text"))).alias("line_md5"), F.length(M.slice_between(F.col("text"), "<p>", ["</p>", "<br"])).alias("paragraph"))


_WS = S.quote(W.SPACES)
_WS_LINE = S.quote(f"[{W.SPACE.replace(chr(10), '')}]+")


def _visible(t: str) -> str:
    v = f"regexp_replace(regexp_replace(regexp_replace({t}, '(?i)<br\\s*/?>', chr(10), 'g'), '(?i)</(p|div|tr|td)>', chr(10), 'g'), '<[^>]*>', '', 'g')"
    for p, c in (("(?i)&nbsp;", "' '"), ("(?i)&quot;", "'\"'"), ("(?i)&#39;|&apos;", "''''"), ("(?i)&lt;", "'<'"), ("(?i)&gt;", "'>'"), ("(?i)&amp;", "'&'")):
        v = f"regexp_replace({v}, '{p}', {c}, 'g')"
    v = f"regexp_replace(regexp_replace(regexp_replace({v}, {_WS_LINE}, ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{{2,}}', chr(10), 'g')"
    return f"regexp_replace({v}, '^[ \\n]+|[ \\n]+$', '', 'g')"


_CHAPTERS = "LEFT JOIN chapters c ON c.collection = r.collection AND c.book_number = r.book_number AND c.ch = r.ch"
_FILLED = "list_filter([{}], lambda p: p IS NOT NULL AND p <> '')"

QUERIES = {
    "split_words": split_words, "normalize_words": normalize_words, "word_variants": word_variants, "unique_terms": unique_terms,
    "query_terms": query_terms, "document_text": document_text, "topic_keys": topic_keys, "content_words": content_words,
    "passages": passages, "record_cards": record_cards, "segments": segments, "quoted_parts": quoted_parts, "highlights": highlights,
    "merged_ranges": merged_ranges, "visible_text": visible_text, "coloured": coloured, "labels": labels,
}

_NUM = lambda x: f"format('{{:,}}', {x})"
_EASTERN = lambda x: f"translate({x}, '0123456789,', '٠١٢٣٤٥٦٧٨٩٬')"
_SEGMENTS = f"""seg AS (SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY side, i) - 1 AS nth, CASE WHEN regexp_full_match(s, '(?s)\\{{[^{{}}]*\\}}') THEN 'quran' WHEN side = 0 THEN 'sanad' ELSE 'matn' END AS kind, {S.trim('s')} AS text
   FROM (SELECT rec_id, side, i, l[i] AS s FROM (SELECT rec_id, side, l, unnest(range(1, len(l) + 1)) AS i FROM (
     SELECT rec_id, side, string_split(regexp_replace(t, '(\\{{[^{{}}]*\\}})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS l
     FROM (SELECT rec_id, 0 AS side, coalesce(ar.sanad, '') AS t FROM {S.records()} UNION ALL SELECT rec_id, 1, coalesce(ar.matn, '') FROM {S.records()})))) WHERE {S.trim('s')} <> '')"""

ORACLES = {
    "segments": f'WITH {_SEGMENTS} SELECT rec_id, nth::INT AS "at", kind, text FROM seg',
    "coloured": f"""WITH {_SEGMENTS}, r AS (SELECT rec_id, count(*)::INT AS spans, string_agg('<span class="ar-' || kind || '">' || replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</span>', ' ' ORDER BY nth) AS h FROM seg GROUP BY rec_id)
        SELECT x.rec_id, coalesce(r.spans, 0)::INT AS spans, md5(coalesce('<p class="arabic" dir="rtl" lang="ar">' || r.h || '</p>', '')) AS html_md5
        FROM {S.records()} x JOIN chapters c ON c.collection = x.collection AND c.book_number = x.book_number AND c.ch = x.ch LEFT JOIN r USING (rec_id)""",
    "labels": f"""SELECT rec_id, {_NUM('rec_id * 977')} AS num_en, {_EASTERN(_NUM('rec_id * 977'))} AS num_ar, {_NUM('floor(rec_id * 977000 / 1e6 + 0.5)::BIGINT')} || ' MB' AS size_en,
        {_EASTERN(_NUM('floor(rec_id * 977000 / 1e6 + 0.5)::BIGINT'))} || ' م.ب' AS size_ar, floor(100.0 / (rec_id + 1) + 0.5)::BIGINT || '%' AS part_en, {_EASTERN('(floor(100.0 / (rec_id + 1) + 0.5)::BIGINT)::VARCHAR')} || '٪' AS part_ar,
        md5(array_to_string({_FILLED.format('ar.matn, ar.sanad, en')}, ' ')) AS text_md5, substr(regexp_replace(array_to_string({_FILLED.format('ar.matn, en')}, ' | '), {_WS}, ' ', 'g'), 1, 90) AS snippet FROM {S.records()}""",
    "split_words": f"SELECT doc_id, len({S.pieces('coalesce(text, $$$$)')})::INT AS words FROM documents",
    "normalize_words": f"SELECT raw, translate(raw, {S.quote(chr(0x670) + W.DROPPED)}, {S.quote(W.ALEF)}) AS bare, {S.is_arabic('raw')} AS arabic, {S.normalize('raw')} AS word FROM {_PIECES}",
    "word_variants": f"""SELECT raw, word, string_agg(term, '|' ORDER BY pos) AS variants FROM (
        {S.variants(f"(SELECT raw, {S.normalize('raw')} AS word FROM {_PIECES})", "raw, word")}) WHERE length(word) >= 2 GROUP BY raw, word""",
    "unique_terms": f"""WITH t AS (SELECT chapter_id, i, l[i] AS raw FROM (SELECT chapter_id, l, unnest(range(1, len(l) + 1)) AS i
          FROM (SELECT chapter_id, {S.pieces("concat_ws(' ', ar, en)")} AS l FROM chapters))),
        w AS (SELECT chapter_id, i, raw, {S.normalize('raw')} AS word FROM t),
        v AS ({S.variants("(SELECT * FROM w WHERE length(word) >= 2)", "chapter_id, i, raw, word")})
        SELECT c.chapter_id, count(v.term)::INT AS terms, coalesce(string_agg(DISTINCT v.term, '|' ORDER BY v.term) FILTER (v.term NOT IN {S.STOPWORDS}), '') AS kept
        FROM chapters c LEFT JOIN v USING (chapter_id) GROUP BY c.chapter_id""",
    "query_terms": f"WITH {S.questions('SELECT item_id AS query_id, text FROM eval_items')} SELECT query_id, grp::INT AS grp, pos::INT AS pos, term, round(weight, 6)::DOUBLE AS weight FROM qterms",
    "document_text": f"WITH {S.DOCS} SELECT doc_id, md5(text) AS text_md5, length(text)::INT AS chars FROM docs",
    "topic_keys": f"""SELECT chapter_id, array_to_string(list_filter(list_transform({S.pieces("lower(concat_ws(' ', ar, en))")},
        lambda w: coalesce(nullif({S.normalize_arabic('w')}, ''), {S.normalize_english('w')})), lambda w: w <> ''), ' ') AS key,
        trim(regexp_replace(translate(translate(coalesce(ar, ''), {S.quote(chr(0x670) + W.DROPPED)}, {S.quote(W.ALEF)}), 'آأإٱ', 'اااا'), {_WS}, ' ', 'g')) AS flat FROM chapters""",
    "content_words": f"""SELECT rec_id, array_to_string(list_sort(list_distinct(list_filter(list_transform({S.pieces("coalesce(en, '')")}, lambda p: {S.normalize('p')}), lambda w: length(w) >= 3))), '|') AS words FROM {S.records()}""",
    "passages": f"""SELECT r.rec_id, md5(trim(regexp_replace(array_to_string({_FILLED.format('r.ar.matn, r.en, c.ar, c.en')}, ' '), {_WS}, ' ', 'g'))) AS passage_md5,
        md5({S.trim("coalesce(nullif(r.ar.matn, ''), nullif(r.ar.sanad, ''), '')")}) AS readable_md5 FROM {S.records()} r {_CHAPTERS}""",
    "record_cards": f"""SELECT r.rec_id, coalesce(nullif(b.arabic, ''), nullif(b.english, ''), '') AS book_ar, coalesce(nullif(b.english, ''), nullif(b.arabic, ''), '') AS book_en,
        CASE WHEN coalesce(r.slug, '') <> '' THEN '/' || r.slug END AS url,
        array_to_string(list_filter([coalesce(nullif(r.ref, ''), nullif(r.slug, '')), nullif(r.inbookref, ''), nullif(coalesce(nullif(c.en, ''), nullif(c.ar, ''), ''), ''), nullif(coalesce(nullif(r.grade, ''), nullif(r.gradear, ''), ''), '')], lambda x: x IS NOT NULL), ' | ') AS chips,
        replace(replace(replace(replace(coalesce(r.en, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS en_html,
        translate(r.pos::VARCHAR, '0123456789', '٠١٢٣٤٥٦٧٨٩') AS pos_text
        FROM {S.records()} r {_CHAPTERS} LEFT JOIN books b ON b.collection = r.collection AND b.book_number = r.book_number""",
    "quoted_parts": f"""SELECT rec_id, count(*) AS quotes, sum(length(q))::BIGINT AS chars FROM (SELECT rec_id, unnest(regexp_extract_all(coalesce(ar.sanad, ''), '\\{{[^{{}}]*\\}}') || regexp_extract_all(coalesce(ar.matn, ''), '\\{{[^{{}}]*\\}}')) AS q FROM {S.records()}) GROUP BY rec_id""",
    "merged_ranges": """WITH e AS (SELECT user_id, date_diff('second', TIMESTAMP '2020-01-01 00:00:00', date_trunc('second', ts)) AS s FROM events),
        m AS (SELECT user_id, s, max(s + 1200) OVER (PARTITION BY user_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
        g AS (SELECT user_id, s, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS grp FROM m)
        SELECT user_id, min(s)::INT AS start, (max(s) + 1200)::INT AS "end" FROM g GROUP BY user_id, grp""",
    "visible_text": f"""SELECT doc_id, md5({_visible('text')}) AS text_md5, md5(trim(regexp_replace({_visible('text')}, {_WS}, ' ', 'g'))) AS line_md5,
        CASE WHEN instr(text, '<p>') = 0 THEN 0 ELSE length(split_part(split_part(substr(text, instr(text, '<p>') + 3), '</p>', 1), '<br', 1)) END::INT AS paragraph
        FROM documents WHERE text IS NOT NULL""",
}
