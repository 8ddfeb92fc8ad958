"""The word rules as SQL text, for the twins of the queries."""

from __future__ import annotations

from siftline.functions import words as W


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SPACES = quote(W.SPACES)
def trim(text: str) -> str:
    """Without white space (the whole class) at either end."""
    return f"regexp_replace({text}, {quote(f'^{W.SPACES}|{W.SPACES}$')}, '', 'g')"


STOPWORDS = "(" + ", ".join(quote(w) for w in W.STOPWORDS) + ")"


def pieces(text: str) -> str:
    return f"list_filter(string_split_regex({text}, {SPACES}), lambda w: w <> '')"


def is_arabic(word: str) -> str:
    return f"regexp_matches({word}, {quote(W.ARABIC)})"


def normalize_arabic(word: str) -> str:
    first = f"translate({word}, {quote(W.FOLDED_FROM[:-2] + W.DROPPED)}, {quote(W.FOLDED_TO[:-2])})"
    joined = f"replace({first}, {quote(W.HAMZA_ALEF)}, {quote(W.ALEF)})"
    return f"regexp_replace(translate({joined}, {quote(W.FOLDED_FROM[-2:])}, {quote(W.FOLDED_TO[-2:])}), {quote(W.NOT_ARABIC_LETTER)}, '', 'g')"


def normalize_english(word: str) -> str:
    return f"regexp_replace(lower({word}), '[^a-z0-9]', '', 'g')"


def normalize(word: str) -> str:
    return f"CASE WHEN {is_arabic(word)} THEN {normalize_arabic(word)} ELSE {normalize_english(word)} END"


def words(text: str) -> str:
    return f"list_filter(list_transform({pieces(text)}, lambda p: {normalize('p')}), lambda w: length(w) >= 2)"


def records(columns: str = "*") -> str:
    """One row per rec_id, the last scraped one."""
    return f"(SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY scraped_at DESC) AS _n FROM hadiths WHERE rec_id IS NOT NULL) WHERE _n = 1)"


def variants(source: str, keys: str) -> str:
    """SELECT of keys, pos, term from a source with (keys, raw, word): the spellings of a word in their order."""
    return f"""
    SELECT {keys}, min(pos) AS pos, term FROM (
      SELECT {keys}, unnest(terms) AS term, unnest(range(len(terms))) AS pos FROM (
        SELECT *, CASE WHEN {is_arabic('raw')} THEN [word, a1, a2, a3,
            CASE WHEN regexp_matches(a3, {quote(W.LONG_END)}) THEN left(a3, length(a3) - 2)
                 WHEN regexp_matches(a3, {quote(W.SHORT_END)}) THEN left(a3, length(a3) - 1)
                 ELSE a3 END]
          ELSE list_filter([word,
            CASE WHEN word LIKE '%ies' AND length(word) > 3 THEN left(word, length(word) - 3) || 'y'
                 WHEN word LIKE '%es' AND length(word) > 4 THEN left(word, length(word) - 2) END,
            CASE WHEN word LIKE '%s' AND word NOT LIKE '%ss' AND length(word) > 3 THEN left(word, length(word) - 1) END], lambda x: x IS NOT NULL)
          END AS terms
        FROM (SELECT *, regexp_replace(a2, {quote(f'^{W.SINGLE}({W.LEFT_OF_SINGLE})$')}, '\\1') AS a3
        FROM (SELECT *, regexp_replace(a1, {quote(f'^{W.PARTICLE}({W.LEFT_OF_PARTICLE})$')}, '\\1') AS a2
        FROM (SELECT *, regexp_replace(word, {quote(f'^{W.LEAD}({W.LEFT_OF_LEAD})$')}, '\\1') AS a1 FROM {source}))))
      ) WHERE length(term) >= 2 GROUP BY {keys}, term"""


DOCS = f"""docs AS (
  SELECT r.rec_id AS doc_id, array_to_string(list_filter([r.ar.matn, r.ar.sanad, r.en, r.narrator, c.ar, c.en], lambda p: p IS NOT NULL AND p <> ''), chr(10)) AS text
  FROM {records()} r LEFT JOIN chapters c ON r.ch >= 0 AND c.collection = r.collection AND c.book_number = r.book_number AND c.ch = r.ch)"""


def index() -> str:
    """CTEs docs, postings, terms (all with df), vocab (kept), lens, corpus."""
    tokens = f"SELECT doc_id, i, l[i] AS raw FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, {pieces('text')} AS l FROM docs))"
    return f"""{DOCS},
  tok AS (SELECT doc_id, i, raw, {normalize('raw')} AS word FROM ({tokens})),
  occ AS (SELECT * FROM ({variants("(SELECT * FROM tok WHERE length(word) >= 2)", "doc_id, i, raw, word")}) WHERE term NOT IN {STOPWORDS}),
  postings AS (SELECT term, doc_id, count(*) AS tf FROM occ GROUP BY ALL),
  terms AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
  vocab AS (SELECT * FROM terms WHERE df <= floor(0.2 * (SELECT count(*) FROM docs))),
  lens AS (SELECT d.doc_id, coalesce(s.n, 0) AS doc_len FROM docs d LEFT JOIN (SELECT doc_id, sum(tf)::BIGINT AS n FROM postings GROUP BY doc_id) s USING (doc_id)),
  corpus AS (SELECT count(*) AS n, floor(avg(doc_len) + 0.5) AS avgdl FROM lens)"""


def questions(source: str) -> str:
    """CTE qterms(query_id, grp, pos, term, weight) from a source of (query_id, text)."""
    return f"""
  qtok AS (SELECT query_id, i, l[i] AS raw FROM (SELECT query_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT query_id, {pieces('text')} AS l FROM ({source})))),
  qword AS (SELECT query_id, arg_min(raw, i) AS raw, min(i) AS i, word FROM (SELECT *, {normalize('raw')} AS word FROM qtok) WHERE length(word) >= 2 GROUP BY query_id, word),
  qvar AS ({variants("qword", "query_id, i, raw, word")}),
  qask AS (SELECT query_id, i, bool_or(term IN {STOPWORDS}) AS asks, count(*) AS n FROM qvar GROUP BY query_id, i),
  qkept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY i) - 1 AS grp FROM (
     SELECT *, count(*) FILTER (NOT asks) OVER (PARTITION BY query_id) AS good FROM qask) WHERE NOT asks OR good = 0),
  qterms AS (SELECT v.query_id, k.grp, row_number() OVER (PARTITION BY v.query_id, k.grp ORDER BY v.pos) - 1 AS pos, v.term, 1.0 / k.n AS weight
     FROM qvar v JOIN qkept k ON v.query_id = k.query_id AND v.i = k.i)"""


SCORES = """
  known AS (SELECT q.*, v.df, ln(1 + (c.n - v.df + 0.5) / (v.df + 0.5)) AS idf FROM qterms q JOIN vocab v USING (term), corpus c),
  worth AS (SELECT query_id, grp, coalesce(min(idf) FILTER (length(term) >= 3), min(idf)) AS idf FROM known GROUP BY query_id, grp),
  best AS (SELECT k.query_id, k.grp, p.doc_id, max(p.tf) AS tf, arg_max(k.term, (p.tf, -k.pos)) AS via FROM known k JOIN postings p USING (term) GROUP BY ALL),
  parts AS (SELECT b.query_id, b.doc_id, b.grp, b.via, b.tf, w.idf,
     w.idf * (b.tf * 2.2) / (b.tf + 1.2 * (1 - 0.75 + 0.75 * ((CASE WHEN l.doc_len = 0 THEN 1 ELSE l.doc_len END) / (CASE WHEN c.avgdl = 0 THEN 1 ELSE c.avgdl END)))) AS score
     FROM best b JOIN worth w USING (query_id, grp) JOIN lens l USING (doc_id), corpus c),
  hits AS (SELECT query_id, doc_id, sum(score ORDER BY grp) AS score, list(via ORDER BY grp) AS terms FROM parts GROUP BY query_id, doc_id),
  lexical AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hits QUALIFY rank <= 60)"""
