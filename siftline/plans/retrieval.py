"""Queries of the word index, the vectors, and the rankings made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.functions import display as D
from siftline.functions import words as W
from siftline.operators import evaluation, lexical, ranking, vectors
from siftline.plans import sql as S
from siftline.session import FORGET, cut, stamp
from siftline.sources.tables import latest_records, table


class Index:
    """The index relations of a folder's records; postings are written once and read by everything else."""

    _made: dict[tuple, Index] = {}

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.posted = cut(lexical.postings(_docs(spark, folder), lengths=True))
        self.ids = latest_records(spark, folder, "rec_id").select(F.col("rec_id").alias("doc_id"))
        self.total = self.ids.count()
        length = self.posted.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
        self.average = int(length / self.total + 0.5) if self.total else 0
        self.vocabulary = cut(lexical.vocabulary(self.posted, self.total))
        self._kept: dict[str, DataFrame] = {}

    @classmethod
    def of(cls, spark: SparkSession, folder: str) -> Index:
        """The index of a folder, made once for this state of its files and kept while the session lasts."""
        key = (spark.sparkContext.applicationId, folder, *(stamp(spark, f"{folder}/{name}.parquet") for name in ("hadiths", "chapters", "vectors", "eval_items")))
        if key not in cls._made:
            cls._made[key] = cls(spark, folder)
        return cls._made[key]

    def kept(self, name: str, made) -> DataFrame:
        """A ranking of the folder's own questions that several queries read, written once."""
        if name not in self._kept:
            self._kept[name] = cut(made())
        return self._kept[name]

    def parts(self, questions: DataFrame) -> DataFrame:
        terms = lexical.query_terms(questions)
        return ranking.contributions(terms, self.posted, None, self.vocabulary, self.total, self.average)

    def ranked(self, terms: DataFrame, limit: int = ranking.POOL) -> DataFrame:
        return ranking.ranked(terms, self.posted, self.vocabulary, self.total, self.average, limit)

    def lexical(self) -> DataFrame:
        return self.kept("lexical", lambda: self.ranked(lexical.query_terms(_questions(self.spark, self.folder))))

    def similar(self) -> DataFrame:
        return self.kept("similar", lambda: _similar(self.spark, self.folder, ranking.POOL))

    def fused(self) -> DataFrame:
        return self.kept("fused", lambda: ranking.fuse(self.lexical(), self.similar()))


FORGET.append(Index._made.clear)


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "eval_items").select(F.col("item_id").alias("query_id"), "text")


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.document_text(latest_records(spark, folder, *lexical.FIELDS), table(spark, folder, "chapters"))


def postings(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.postings(_docs(spark, folder))


def term_df(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.frequencies(lexical.postings(_docs(spark, folder)))


def doc_lengths(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder)
    return lexical.doc_lengths(docs, lexical.postings(docs))


def corpus_figures(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder)
    return lexical.corpus_figures(docs, cut(lexical.postings(docs)))


def vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return Index.of(spark, folder).vocabulary.orderBy("term")


def posting_deltas(spark: SparkSession, folder: str) -> DataFrame:
    """Gaps between a term's documents, as the binary format stores them."""
    along = Window.partitionBy("term").orderBy("doc_id")
    return postings(spark, folder).select("term", "doc_id", (F.col("doc_id") - F.lag("doc_id", 1, 0).over(along)).alias("delta"), "tf")


def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    hits = Index.of(spark, folder).lexical()
    return hits.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.array_join("terms", "|").alias("terms"), "rank")


def bm25_plain(spark: SparkSession, folder: str) -> DataFrame:
    """Glossary terms as plain-string questions, with other constants and twenty results each."""
    index = Index.of(spark, folder)
    asked = table(spark, folder, "glossary").select(F.col("term_id").alias("query_id"), W.words(F.col("en_term")).alias("terms"))
    hits = ranking.ranked(lexical.plain_terms(asked), index.posted, index.vocabulary, index.total, index.average, 20, 0.9, 0.4)
    return hits.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def bm25_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    """What every word of a question adds to its first three records, and the words of the record that met it."""
    index = Index.of(spark, folder)
    first = index.lexical().where("rank <= 3").select("query_id", "doc_id", "rank")
    parts = cut(index.parts(_questions(spark, folder)).join(first, ["query_id", "doc_id"]))
    texts = latest_records(spark, folder, "ar", "en").select(F.col("rec_id").alias("doc_id"), D.text_of(F.col("ar"), F.col("en")).alias("text"))
    met = ranking.sources(parts, lexical.query_terms(_questions(spark, folder)), index.vocabulary, texts)
    rows = parts.join(met, ["query_id", "doc_id", "grp"], "left")
    return rows.select(
        "query_id", "doc_id", "rank", "grp", "via", "tf", F.round("idf", 6).alias("idf"), F.round("score", 6).alias("score"),
        F.coalesce(F.array_join("words", "|"), F.lit("")).alias("words"),
    )


def record_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Where every question's own vector's record stands in its whole ranking by words, and what stands right above."""
    index = Index.of(spark, folder)
    parts = ranking.scores(lexical.query_terms(_questions(spark, folder)), index.posted, index.vocabulary, index.total, index.average)
    hits = parts.groupBy("query_id", "doc_id").agg(F.round(F.sum("score"), 6).alias("score"))
    own = table(spark, folder, "vectors").where("rec_id is not null").groupBy("vec_id").agg(F.min("rec_id").alias("doc_id"))
    wanted = _questions(spark, folder).select("query_id").join(own.withColumnRenamed("vec_id", "query_id"), "query_id")
    found = ranking.places(wanted, hits)
    return found.select("query_id", "doc_id", "rank", "of", F.array_join(F.transform("above", lambda x: x.cast("string")), "|").alias("above"))


def unknown_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Words of the questions that the index doesn't hold (an anti-join with the vocabulary)."""
    return lexical.query_terms(_questions(spark, folder)).join(Index.of(spark, folder).vocabulary, "term", "left_anti").select("query_id", "term").distinct()


def dims(spark: SparkSession, folder: str) -> int:
    """Components of a vector by the latest build of every shard."""
    builds = table(spark, folder, "manifest").groupBy("collection", "first_book", "last_book").agg(F.max(F.struct("built", "build_id", "vectors"))["vectors"].alias("v"))
    return builds.agg(F.coalesce(F.max("v.dims"), F.lit(0))).first()[0]


def _similar(spark: SparkSession, folder: str, limit: int) -> DataFrame:
    """Each question's vector is the one whose id it bears: the model behind the vectors isn't at hand."""
    rows = table(spark, folder, "vectors").where("vec_id is not null").dropDuplicates(["vec_id"])
    usable = rows.where((F.size("q") == dims(spark, folder)) & F.col("rec_id").isNotNull() & F.col("scale").isNotNull())
    asked = usable.join(F.broadcast(_questions(spark, folder).select("query_id")), F.col("vec_id") == F.col("query_id"))
    queries = asked.select("query_id", vectors.dequantize(F.col("scale"), F.col("q")).alias("vector"))
    found = vectors.similar(queries, usable.select(F.col("rec_id").alias("doc_id"), "scale", "q"), limit)
    return found.withColumn("score", F.col("score").cast("double"))


def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Records by the best of their vectors, for every twentieth vector as a query."""
    rows = table(spark, folder, "vectors").where("vec_id is not null").dropDuplicates(["vec_id"])
    usable = rows.where((F.size("q") == dims(spark, folder)) & F.col("rec_id").isNotNull() & F.col("scale").isNotNull())
    queries = usable.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), vectors.dequantize(F.col("scale"), F.col("q")).alias("vector"))
    found = vectors.similar(queries, usable.select(F.col("rec_id").alias("doc_id"), "scale", "q"), 50)
    return found.select("query_id", "doc_id", F.round(F.col("score").cast("double"), 4).alias("score"), "rank").drop("rank")


def embedding_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Float vectors, every twentieth as a query, against all: exact cosines, quantised on the way."""
    rows = table(spark, folder, "embeddings")
    coded = rows.select("vec_id", vectors.quantize(F.col("embedding")).alias("c"))
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = vectors.similar(asked, coded.select(F.col("vec_id").alias("doc_id"), "c.scale", "c.q"), 10)
    return found.select("query_id", "doc_id", F.round(F.col("score").cast("double"), 4).alias("score"))


def quantized(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", vectors.quantize(F.col("embedding")).alias("c"))
    return rows.select("vec_id", F.round(F.col("c.scale").cast("double"), 6).alias("scale"), F.array_join(F.transform("c.q", lambda x: x.cast("string")), ",").alias("q"))


def vector_norms(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.checks(table(spark, folder, "vectors"), dims(spark, folder))


def label_centres(spark: SparkSession, folder: str) -> DataFrame:
    """Mean pooling at unit length, a label's vectors as one text's tokens."""
    rows = table(spark, folder, "embeddings").select(F.col("label").alias("text_id"), F.lit(1).alias("mask"), F.col("embedding").alias("vector"))
    pooled = vectors.mean_pool(rows)
    return pooled.select(F.col("text_id").alias("label"), F.posexplode("vector").alias("d", "x")).select("label", "d", F.round(F.col("x").cast("double"), 4).alias("x"))


def passage_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of long documents; words stand in for the encoder's tokens, which aren't at hand."""
    rows = table(spark, folder, "documents").where("text is not null").select("doc_id", "text", F.filter(F.split("text", "[ \\t\\r\\n]+"), lambda w: w != "").alias("w"))
    parts = vectors.windows(F.col("text"), "passage", F.size("w") * 4, F.col("w"))
    return rows.select("doc_id", F.size(parts).alias("windows"), F.md5(F.array_join(parts, "|")).alias("text_md5"))


def _fused(spark: SparkSession, folder: str) -> tuple[Index, DataFrame, DataFrame, DataFrame]:
    index = Index.of(spark, folder)
    return index, index.lexical(), index.similar(), index.fused()


def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    _, _, _, fused = _fused(spark, folder)
    why = D.why(F.col("lexical_rank"), F.col("vector_rank"), F.col("terms"))
    return fused.select("query_id", "doc_id", "rank", F.round("score", 8).alias("score"), "lexical_rank", "vector_rank", why.alias("why"))


def rrf_weighted(spark: SparkSession, folder: str) -> DataFrame:
    _, lex, sim, _ = _fused(spark, folder)
    fused = ranking.fuse(lex, sim, 15, 2.0, 0.5)
    return fused.select("query_id", "doc_id", "rank", F.round("score", 8).alias("score"))


def confidence(spark: SparkSession, folder: str) -> DataFrame:
    _, lex, sim, fused = _fused(spark, folder)
    return ranking.summary(_questions(spark, folder), fused, lex, sim)


def highlight_terms(spark: SparkSession, folder: str) -> DataFrame:
    index, _, _, fused = _fused(spark, folder)
    found = ranking.highlight_terms(fused, index.vocabulary, index.total)
    return found.select("query_id", "doc_id", F.array_join("highlight", "|").alias("highlight"))


def ask_hydrated(spark: SparkSession, folder: str) -> DataFrame:
    """Answers with their record, book, chapter and link; records join last, on the few ids that are left."""
    _, _, _, fused = _fused(spark, folder)
    ids = fused.select(F.col("doc_id").alias("rec_id"))
    got = ranking.hydrate(fused, latest_records(spark, folder, "collection", "book_number", "ch", "slug", only=ids), table(spark, folder, "books"), table(spark, folder, "chapters"))
    return got.select("query_id", F.col("rec_id").alias("doc_id"), "rank", "collection", "book", "chapter", "url", (F.col("rank") == 1).alias("answer"))


def answers_by_collection(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of the groups that the results after the first come in."""
    got = ask_hydrated(spark, folder).where("not answer")
    return got.groupBy("query_id", "collection").agg(F.count("*").alias("results"), F.min("rank").alias("best"))


def _rare(spark: SparkSession, folder: str) -> DataFrame:
    index = Index.of(spark, folder)
    rows = latest_records(spark, folder, "ar", "en")
    text = F.array_join(F.filter(F.array("ar.matn", "en"), lambda p: p.isNotNull() & (p != "")), " ")
    placed = lexical.first_places(rows.select(F.col("rec_id").alias("doc_id"), text.alias("text")))
    return index.kept("rare", lambda: evaluation.rare_terms(placed, index.vocabulary))


def rare_terms(spark: SparkSession, folder: str) -> DataFrame:
    return _rare(spark, folder)


def sampled_records(spark: SparkSession, folder: str) -> DataFrame:
    """The evaluation's sample: 150 places drawn with replacement by the seeded generator, at most three attempts for
    each, of records with three rare terms."""
    places = evaluation.numbered(latest_records(spark, folder, "rec_id"), "rec_id")
    attempts = F.broadcast(spark.createDataFrame(evaluation.drawn(places.count()), "attempt int, place bigint"))
    fit = _rare(spark, folder).select(F.col("doc_id").alias("rec_id")).distinct()
    drawn = attempts.join(places, "place").join(fit, "rec_id")
    return evaluation.accepted(drawn).select("draw", "rec_id")


def rare_term_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """How well the sampled records are found again by their three rarest shared terms: hit@k and mean reciprocal rank."""
    rare, draws = _rare(spark, folder), cut(sampled_records(spark, folder))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "term"))), lambda x: x["term"]), " ")
    asked = rare.join(draws.select(F.col("rec_id").alias("doc_id")).distinct(), "doc_id").groupBy(F.col("doc_id").alias("query_id")).agg(listed.alias("text"))
    found = Index.of(spark, folder).ranked(lexical.query_terms(asked), 10).where("query_id = doc_id").select(F.col("query_id").alias("rec_id"), "rank")
    ranks = draws.join(found, "rec_id", "left")
    return evaluation.metrics(ranks).select("samples", *[F.round(c, 6).alias(c) for c in ("hit_1", "hit_5", "hit_10", "mrr_10")])


def _markers(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, phrase, words): glossary terms all of whose words stand in a question are what its answer should hold."""
    words = _questions(spark, folder).select("query_id", F.explode(D.content_words(F.col("text"))).alias("word"))
    terms = table(spark, folder, "glossary").select(D.content_words(F.col("en_term")).alias("words")).where("size(words) > 0").distinct()
    met = terms.select("words", F.explode("words").alias("word")).join(words, "word").groupBy("query_id", "words").agg(F.count("*").alias("n"))
    return met.where("n = size(words)").select("query_id", F.array_join("words", " ").alias("phrase"), "words")


def _flat(spark: SparkSession, folder: str, only: DataFrame | None = None) -> DataFrame:
    """Every record's distinct content words in their order, joined by spaces; only: the rec_ids wanted."""
    rows = latest_records(spark, folder, "ar", "en", only=only)
    return rows.select(F.col("rec_id").alias("doc_id"), D.content_words(D.text_of(F.col("ar"), F.col("en"))).alias("words")).withColumn("text", F.array_join("words", " "))


def unanswerable(spark: SparkSession, folder: str) -> DataFrame:
    """Questions none of whose markers the corpus holds: all without the answerable ones."""
    answerable = evaluation.present(_flat(spark, folder), cut(_markers(spark, folder)))
    return _questions(spark, folder).select("query_id").join(answerable, "query_id", "left_anti")


def _answers(spark: SparkSession, folder: str, ranked: DataFrame) -> DataFrame:
    """Words are made for the ranked records only, and never broadcast: Spark counts 20 bytes for all words of a record,
    so it would take those of a whole corpus for a small table."""
    markers = _markers(spark, folder).groupBy("query_id").agg(F.collect_set("words").alias("markers"))
    first = ranked.where("rank <= 10").select("query_id", "doc_id", "rank")
    body = _flat(spark, folder, first.select(F.col("doc_id").alias("rec_id"))).select("doc_id", "words").hint("merge")
    rows = first.join(markers, "query_id").join(body, "doc_id")
    return evaluation.first_good(rows, evaluation.answers_with(F.col("words"), F.col("markers")))


def answer_markers(spark: SparkSession, folder: str) -> DataFrame:
    """First answer by words that holds all content words of some marker of the question; null without one."""
    return _answers(spark, folder, Index.of(spark, folder).lexical())


def question_passes(spark: SparkSession, folder: str) -> DataFrame:
    """Of the answerable questions, how many have a good answer among the first ten and as the first, in either mode."""
    index = Index.of(spark, folder)
    asked = _questions(spark, folder).select("query_id").join(unanswerable(spark, folder), "query_id", "left_anti")
    ranks = None
    for mode, found in (("words only", index.lexical()), ("words and meaning", index.fused())):
        own = asked.join(_answers(spark, folder, found), "query_id", "left").select(F.lit(mode).alias("mode"), "query_id", "rank")
        ranks = own if ranks is None else ranks.unionByName(own)
    return evaluation.passes(ranks)


def index_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the word index and the vectors stand for the same records: counts of both, and records of one only."""
    return vectors.agreement(Index.of(spark, folder).ids, table(spark, folder, "vectors").select(F.col("rec_id").alias("doc_id")))


def prefix_index(spark: SparkSession, folder: str) -> DataFrame:
    """Figures of an index built from the first thousand records only (a trial build)."""
    places = evaluation.numbered(latest_records(spark, folder, "rec_id"), "rec_id")
    docs = _docs(spark, folder).join(places.where("place < 1000").select(F.col("rec_id").alias("doc_id")), "doc_id", "left_semi")
    return lexical.corpus_figures(docs, cut(lexical.postings(docs)))


_TEXT_OF = "array_to_string(list_filter([r.ar.matn, r.ar.sanad, r.en], lambda p: p IS NOT NULL AND p <> ''), ' ')"
_DISTINCT = "(SELECT list(w ORDER BY k) FROM (SELECT w, min(k) AS k FROM (SELECT unnest(z) AS w, unnest(range(len(z))) AS k FROM (SELECT {} AS z)) GROUP BY w))"
_ASKED = f"WITH {S.index()}, {S.questions('SELECT item_id AS query_id, text FROM eval_items')}, {S.SCORES}"
_DIMS = "dims AS (SELECT max(x) AS d FROM (SELECT arg_max(vectors.dims, built) AS x FROM manifest GROUP BY collection, first_book, last_book))"
_SIMILAR = f"""{_DIMS}, uv AS (SELECT vec_id, any_value(rec_id) AS doc_id, any_value(scale)::DOUBLE AS scale, any_value(q) AS q FROM vectors WHERE len(q) = (SELECT d FROM dims) AND rec_id IS NOT NULL AND scale IS NOT NULL GROUP BY vec_id),
  qv AS (SELECT u.vec_id AS query_id, list_transform(u.q, lambda x: (x::FLOAT * u.scale::FLOAT)::DOUBLE) AS v FROM uv u JOIN eval_items e ON e.item_id = u.vec_id),
  sims AS (SELECT query_id, doc_id, max((list_dot_product(list_transform(u.q, lambda x: x::DOUBLE), qv.v) * u.scale)::FLOAT) AS score FROM qv, uv u GROUP BY query_id, doc_id),
  semantic AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sims QUALIFY rank <= 60)"""


def _fuse(limit: int, a: float, b: float) -> str:
    return f"""{_ASKED}, {_SIMILAR},
  both_ AS (SELECT coalesce(l.query_id, s.query_id) AS query_id, coalesce(l.doc_id, s.doc_id) AS doc_id, coalesce(l.rank, 0) AS lexical_rank, coalesce(s.rank, 0) AS vector_rank, coalesce(l.terms, []) AS terms,
     coalesce({a}::DOUBLE / (60 + l.rank), 0) + coalesce({b}::DOUBLE / (60 + s.rank), 0) AS score FROM lexical l FULL JOIN semantic s ON l.query_id = s.query_id AND l.doc_id = s.doc_id),
  fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM both_ QUALIFY rank <= {limit})"""


_HYDRATED = f"""{_fuse(20, 1, 1)} , answers AS (SELECT f.query_id, f.doc_id, f.rank::INT AS rank, r.collection, b.english AS book, c.en AS chapter,
   CASE WHEN coalesce(r.slug, '') <> '' THEN r.slug END AS url, f.rank = 1 AS answer
   FROM fused f JOIN {S.records()} r ON r.rec_id = f.doc_id LEFT JOIN books b ON b.collection = r.collection AND b.book_number = r.book_number
   LEFT JOIN chapters c ON c.collection = r.collection AND c.book_number = r.book_number AND c.ch = r.ch)"""

_RARE = f"""WITH {S.index()}, rdocs AS (SELECT rec_id AS doc_id, array_to_string(list_filter([ar.matn, en], lambda p: p IS NOT NULL AND p <> ''), ' ') AS text FROM {S.records()}),
  rtok AS (SELECT doc_id, i, l[i] AS raw FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, {S.pieces('text')} AS l FROM rdocs))),
  rword AS (SELECT *, {S.normalize('raw')} AS word FROM rtok), rocc AS ({S.variants("(SELECT * FROM rword WHERE length(word) >= 2)", "doc_id, i, raw, word")}),
  rfit AS (SELECT o.doc_id, o.term, v.df, min((o.i, o.pos)) AS place FROM rocc o JOIN vocab v USING (term) WHERE length(o.term) >= 4 AND v.df BETWEEN 2 AND 20 GROUP BY ALL),
  rare AS (SELECT doc_id, term, df, nth::INT AS nth FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY df, place) AS nth, count(*) OVER (PARTITION BY doc_id) AS n FROM rfit) WHERE nth <= 3 AND n >= 3)"""
_DRAWS = ", ".join(f"({i}, {u!r}::DOUBLE)" for i, u in zip(range(evaluation.SAMPLES * 3), evaluation.mulberry32(evaluation.SEED)))
_DRAWN = f"""attempts AS (SELECT * FROM (VALUES {_DRAWS}) t(attempt, u)), placed AS (SELECT rec_id, row_number() OVER (ORDER BY rec_id) - 1 AS place FROM {S.records('rec_id')}),
  drawn AS (SELECT row_number() OVER (ORDER BY attempt) - 1 AS draw, rec_id FROM attempts a JOIN placed p ON p.place = floor(a.u * (SELECT count(*) FROM placed))
    WHERE rec_id IN (SELECT doc_id FROM rare) QUALIFY draw < {evaluation.SAMPLES})"""
_CONTENT = lambda t: _DISTINCT.format(f"list_filter(list_transform({S.pieces(t)}, lambda p: {S.normalize('p')}), lambda w: length(w) >= 3)")
_MARKED = f"""flat AS (SELECT doc_id, w, array_to_string(w, ' ') AS text FROM (SELECT rec_id AS doc_id, {_CONTENT(_TEXT_OF)} AS w FROM {S.records()} r)),
  qw AS (SELECT item_id AS query_id, {_CONTENT("coalesce(text, '')")} AS w FROM eval_items), gl AS (SELECT DISTINCT words FROM (SELECT {_CONTENT("coalesce(en_term, '')")} AS words FROM glossary) WHERE len(words) > 0),
  markers AS (SELECT query_id, words, array_to_string(words, ' ') AS phrase FROM qw JOIN gl ON list_has_all(qw.w, gl.words))"""
_PRESENT = """needles AS (SELECT DISTINCT n FROM (SELECT phrase AS n FROM markers UNION ALL SELECT unnest(words) FROM markers)), held AS (SELECT n FROM needles WHERE EXISTS (SELECT 1 FROM flat WHERE contains(flat.text, needles.n))),
  lacking AS (SELECT DISTINCT query_id, phrase FROM (SELECT query_id, phrase, unnest(words) AS w FROM markers) WHERE w NOT IN (SELECT n FROM held)),
  present AS (SELECT DISTINCT query_id FROM markers m WHERE phrase IN (SELECT n FROM held) OR NOT EXISTS (SELECT 1 FROM lacking k WHERE k.query_id = m.query_id AND k.phrase = m.phrase))"""

QUERIES = {
    f.__name__: f
    for f in (
        postings, term_df, doc_lengths, corpus_figures, vocabulary, posting_deltas, bm25_topk, bm25_plain, bm25_breakdown, record_ranks, unknown_terms, vector_topk,
        embedding_topk, quantized, vector_norms, label_centres, passage_windows, rrf_fusion, rrf_weighted, confidence, highlight_terms,
        ask_hydrated, answers_by_collection, rare_terms, sampled_records, rare_term_metrics, answer_markers, unanswerable, question_passes, index_agreement,
        prefix_index,
    )
}

_INDEX = f"WITH {S.index()}"

ORACLES = {
    "postings": f"{_INDEX} SELECT * FROM postings",
    "term_df": f"{_INDEX} SELECT * FROM terms",
    "doc_lengths": f"{_INDEX} SELECT * FROM lens",
    "corpus_figures": f"""{_INDEX} SELECT n AS doc_count, avgdl::BIGINT AS avg_doc_len, (SELECT count(*) FROM vocab) AS term_count,
        (SELECT count(*) FROM terms) - (SELECT count(*) FROM vocab) AS dropped_terms, (SELECT coalesce(sum(df), 0)::BIGINT FROM vocab) AS postings FROM corpus""",
    "vocabulary": f"{_INDEX} SELECT * FROM vocab",
    "posting_deltas": f"{_INDEX} SELECT term, doc_id, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY term ORDER BY doc_id) AS delta, tf FROM postings",
    "bm25_topk": f"{_ASKED} SELECT query_id, doc_id, round(score, 6) AS score, array_to_string(terms, '|') AS terms, rank::INT AS rank FROM lexical",
    "bm25_breakdown": f"""{_ASKED}, first3 AS (SELECT query_id, doc_id, rank FROM lexical WHERE rank <= 3),
        raws AS (SELECT query_id, doc_id, l[i] AS raw, min(i) AS i FROM (SELECT f.query_id, f.doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (
          SELECT query_id, doc_id, {S.pieces(_TEXT_OF)} AS l FROM first3 f JOIN {S.records()} r ON r.rec_id = f.doc_id) f) GROUP BY ALL),
        made AS (SELECT *, {S.normalize('raw')} AS word FROM raws), spelt AS ({S.variants("(SELECT * FROM made WHERE word <> '')", "query_id, doc_id, i, raw, word")}),
        met AS (SELECT s.query_id, s.doc_id, k.grp, s.raw, min((k.pos, s.i)) AS p FROM spelt s JOIN known k ON k.query_id = s.query_id AND k.term = s.term GROUP BY ALL),
        words AS (SELECT query_id, doc_id, grp, array_to_string(list(raw ORDER BY p, raw)[:5], '|') AS words FROM met GROUP BY ALL)
        SELECT p.query_id, p.doc_id, l.rank::INT AS rank, p.grp::INT AS grp, p.via, p.tf, round(p.idf, 6) AS idf, round(p.score, 6) AS score, coalesce(w.words, '') AS words
        FROM parts p JOIN first3 l USING (query_id, doc_id) LEFT JOIN words w USING (query_id, doc_id, grp)""",
    "bm25_plain": f"""WITH {S.index()}, qterms AS (SELECT query_id, i - 1 AS grp, 0 AS pos, l[i] AS term FROM (SELECT query_id, l, unnest(range(1, len(l) + 1)) AS i FROM (
          SELECT term_id AS query_id, {_DISTINCT.format(S.words("coalesce(en_term, '')"))} AS l FROM glossary))), {S.SCORES.replace("2.2", "1.9").replace("1.2 * (1 - 0.75 + 0.75 *", "0.9 * (1 - 0.4 + 0.4 *").replace("rank <= 60", "rank <= 20")}
        SELECT query_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM lexical""",
    "record_ranks": f"""{_ASKED}, own AS (SELECT e.item_id AS query_id, min(v.rec_id) AS doc_id FROM eval_items e JOIN vectors v ON v.vec_id = e.item_id WHERE v.rec_id IS NOT NULL GROUP BY 1),
        h AS (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank, count(*) OVER (PARTITION BY query_id) AS n FROM hits)
        SELECT o.query_id, o.doc_id, coalesce(h.rank, 0) AS rank, coalesce((SELECT count(*) FROM h x WHERE x.query_id = o.query_id), 0) AS "of",
          coalesce((SELECT string_agg(x.doc_id::VARCHAR, '|' ORDER BY x.rank) FROM h x WHERE x.query_id = o.query_id AND x.rank BETWEEN h.rank - 3 AND h.rank - 1), '') AS above
        FROM own o LEFT JOIN h USING (query_id, doc_id)""",
    "unknown_terms": f"{_ASKED} SELECT DISTINCT query_id, term FROM qterms ANTI JOIN vocab USING (term)",
    "vector_topk": f"""WITH {_SIMILAR.replace("JOIN eval_items e ON e.item_id = u.vec_id", "WHERE u.vec_id % 20 = 0").replace("rank <= 60", "rank <= 50")}
        SELECT query_id, doc_id, round(score::DOUBLE, 4) AS score FROM semantic""",
    "vector_norms": f"""WITH {_DIMS} SELECT count(*) AS vectors, count(*) FILTER (q IS NULL) AS empty, count(*) FILTER (q IS NOT NULL AND len(q) <> (SELECT d FROM dims)) AS other_length,
        count(*) FILTER (len(q) = (SELECT d FROM dims) AND abs(sqrt(list_sum(list_transform(q, lambda x: (x * scale)::DOUBLE * (x * scale)))) - 1) > 0.01) AS not_unit FROM vectors""",
    "label_centres": """WITH t AS (SELECT label, unnest(range(len(embedding))) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, d, avg(x) AS m FROM t GROUP BY ALL),
        n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY label) SELECT m.label, d::INT AS d, round((m / CASE WHEN n > 0 THEN n ELSE 1 END)::FLOAT::DOUBLE, 4) AS x FROM m JOIN n USING (label)""",
    "quantized": """WITH s AS (SELECT vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) / 127 AS s FROM embeddings),
        z AS (SELECT vec_id, embedding, CASE WHEN s > 0 THEN s ELSE 1.0 END AS s FROM s)
        SELECT vec_id, round(s::FLOAT::DOUBLE, 6) AS scale, array_to_string(list_transform(embedding, lambda x: least(127, greatest(-127, floor(x::DOUBLE / s + 0.5)))::INT), ',') AS q FROM z""",
    "rrf_fusion": f"""{_fuse(20, 1, 1)} SELECT query_id, doc_id, rank::INT AS rank, round(score, 8) AS score, lexical_rank::INT AS lexical_rank, vector_rank::INT AS vector_rank,
        CASE WHEN lexical_rank > 0 AND vector_rank > 0 THEN 'both' WHEN lexical_rank > 0 THEN 'words' WHEN vector_rank > 0 THEN 'meaning' ELSE 'weak' END
        || CASE WHEN len(terms) > 0 THEN ': ' || array_to_string(list_transform(list_filter(list_transform(range(1, len(terms) + 1), lambda i: [i, list_position(terms, terms[i])]), lambda p: p[1] = p[2])[:6], lambda p: terms[p[1]]), ', ') ELSE '' END AS why FROM fused""",
    "rrf_weighted": f"{_fuse(15, 2, 0.5)} SELECT query_id, doc_id, rank::INT AS rank, round(score, 8) AS score FROM fused",
    "confidence": f"""{_fuse(20, 1, 1)} SELECT e.item_id AS query_id, CASE WHEN f.doc_id IS NULL THEN 'none' WHEN lexical_rank BETWEEN 1 AND 3 AND vector_rank BETWEEN 1 AND 3 THEN 'strong'
        WHEN lexical_rank > 0 AND vector_rank > 0 THEN 'good' WHEN lexical_rank BETWEEN 1 AND 3 OR vector_rank BETWEEN 1 AND 3 THEN 'fair' ELSE 'weak' END AS confidence,
        (SELECT count(*) FROM lexical l WHERE l.query_id = e.item_id) AS lexical_count, (SELECT count(*) FROM semantic s WHERE s.query_id = e.item_id) AS semantic_count
        FROM eval_items e LEFT JOIN fused f ON f.query_id = e.item_id AND f.rank = 1""",
    "highlight_terms": f"""{_fuse(20, 1, 1)}, t AS (SELECT query_id, doc_id, unnest(terms) AS term, unnest(range(len(terms))) AS k FROM fused),
        o AS (SELECT query_id, doc_id, term, min(k) AS k FROM t GROUP BY ALL), r AS (SELECT o.*, v.df, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY v.df, o.k) AS nth
          FROM o JOIN vocab v USING (term), corpus c WHERE v.df <= floor(c.n * 0.15 + 0.5)),
        h AS (SELECT query_id, doc_id, string_agg(term, '|' ORDER BY nth) AS highlight FROM r WHERE nth <= 6 GROUP BY ALL)
        SELECT f.query_id, f.doc_id, coalesce(h.highlight, '') AS highlight FROM fused f LEFT JOIN h USING (query_id, doc_id)""",
    "ask_hydrated": f"{_HYDRATED} SELECT * FROM answers",
    "answers_by_collection": f"{_HYDRATED} SELECT query_id, collection, count(*) AS results, min(rank) AS best FROM answers WHERE NOT answer GROUP BY ALL",
    "rare_terms": f"{_RARE} SELECT doc_id, term, df, nth FROM rare",
    "sampled_records": f"""{_RARE}, {_DRAWN} SELECT draw::INT AS draw, rec_id FROM drawn""",
    "rare_term_metrics": f"""{_RARE}, {_DRAWN},
        {S.questions("SELECT doc_id AS query_id, string_agg(term, ' ' ORDER BY nth) AS text FROM rare WHERE doc_id IN (SELECT rec_id FROM drawn) GROUP BY doc_id")}, {S.SCORES},
        f AS (SELECT d.draw, coalesce(l.rank, 0) AS r FROM drawn d LEFT JOIN lexical l ON l.query_id = d.rec_id AND l.doc_id = d.rec_id AND l.rank <= 10)
        SELECT count(*) AS samples, round(avg((r = 1)::INT), 6) AS hit_1, round(avg((r BETWEEN 1 AND 5)::INT), 6) AS hit_5, round(avg((r BETWEEN 1 AND 10)::INT), 6) AS hit_10,
          round(avg(CASE WHEN r > 0 THEN 1.0::DOUBLE / r ELSE 0 END), 6) AS mrr_10 FROM f""",
    "answer_markers": f"{_ASKED}, {_MARKED} SELECT query_id, min(rank)::INT AS rank FROM (SELECT l.query_id, CASE WHEN list_has_all(f.w, m.words) THEN l.rank END AS rank FROM lexical l JOIN markers m USING (query_id) JOIN flat f ON f.doc_id = l.doc_id WHERE l.rank <= 10) GROUP BY query_id",
    "unanswerable": f"WITH {_MARKED}, {_PRESENT} SELECT item_id AS query_id FROM eval_items WHERE item_id NOT IN (SELECT query_id FROM present)",
    "question_passes": f"""{_fuse(20, 1, 1)}, {_MARKED}, {_PRESENT}, both_modes AS (SELECT 'words only' AS mode, query_id, doc_id, rank FROM lexical UNION ALL SELECT 'words and meaning', query_id, doc_id, rank FROM fused),
        good AS (SELECT b.mode, b.query_id, min(b.rank) AS rank FROM both_modes b JOIN markers m USING (query_id) JOIN flat f ON f.doc_id = b.doc_id WHERE b.rank <= 10 AND list_has_all(f.w, m.words) GROUP BY ALL)
        SELECT m.mode, count(*) AS questions, count(*) FILTER (g.rank BETWEEN 1 AND 10) AS top_10, count(*) FILTER (g.rank = 1) AS top_1
        FROM present p CROSS JOIN (SELECT unnest(['words only', 'words and meaning']) AS mode) m LEFT JOIN good g ON g.query_id = p.query_id AND g.mode = m.mode GROUP BY m.mode""",
    "index_agreement": f"""WITH a AS (SELECT DISTINCT rec_id FROM hadiths WHERE rec_id IS NOT NULL), b AS (SELECT DISTINCT rec_id FROM vectors WHERE rec_id IS NOT NULL)
        SELECT (SELECT count(*) FROM a) AS documents, (SELECT count(*) FROM b) AS with_vectors, (SELECT count(*) FROM a ANTI JOIN b USING (rec_id)) AS words_only,
        (SELECT count(*) FROM b ANTI JOIN a USING (rec_id)) AS vectors_only, NOT EXISTS (FROM a ANTI JOIN b USING (rec_id)) AND NOT EXISTS (FROM b ANTI JOIN a USING (rec_id)) AS agree""",
    "prefix_index": f"""WITH {S.index().replace("FROM " + S.records() + " r LEFT JOIN", "FROM (SELECT * FROM " + S.records() + " ORDER BY rec_id LIMIT 1000) r LEFT JOIN")}
        SELECT n AS doc_count, avgdl::BIGINT AS avg_doc_len, (SELECT count(*) FROM vocab) AS term_count,
        (SELECT count(*) FROM terms) - (SELECT count(*) FROM vocab) AS dropped_terms, (SELECT coalesce(sum(df), 0)::BIGINT FROM vocab) AS postings FROM corpus""",
    "embedding_topk": """WITH s AS (SELECT vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) / 127 AS s FROM embeddings), z AS (SELECT vec_id, embedding, CASE WHEN s > 0 THEN s ELSE 1.0 END AS s FROM s),
        c AS (SELECT vec_id, s::FLOAT::DOUBLE AS s, list_transform(embedding, lambda x: least(127, greatest(-127, floor(x::DOUBLE / s + 0.5)))) AS q FROM z),
        p AS (SELECT e.vec_id AS query_id, c.vec_id AS doc_id, (list_dot_product(c.q, list_transform(e.embedding, lambda x: x::DOUBLE)) * c.s)::FLOAT AS score FROM embeddings e, c WHERE e.vec_id % 20 = 0)
        SELECT query_id, doc_id, round(score::DOUBLE, 4) AS score FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10""",
    "passage_windows": f"""WITH d AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
        n AS (SELECT *, len(w) * 4 AS tokens FROM d), p AS (SELECT *, greatest(2, ceil(tokens / 488.0)) AS pieces FROM n), z AS (SELECT *, ceil(len(w) / pieces)::INT AS size FROM p),
        t AS (SELECT *, greatest(1, floor(size * 0.8 + 0.5)::INT) AS step FROM z),
        s AS (SELECT *, list_filter(range(0, greatest(len(w), 1), step), lambda x: x = 0 OR x - step + size < len(w))[:4] AS starts FROM t),
        x AS (SELECT doc_id, CASE WHEN length('passage: ' || text) <= 900 OR tokens <= 512 OR len(w) = 0 THEN ['passage: ' || text]
          ELSE list_transform(starts, lambda x: 'passage: ' || array_to_string(w[x + 1:x + size], ' ')) END AS parts FROM s)
        SELECT doc_id, len(parts)::INT AS windows, md5(array_to_string(parts, '|')) AS text_md5 FROM x""",
}
