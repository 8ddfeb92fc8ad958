"""SQL twins of the pN_ queries that SQL can express on whole tables."""

from __future__ import annotations

from siftline.plans import sql as S

_R = S.records()


def _tf(text: str, source: str = _R) -> str:
    return f"SELECT rec_id, term, count(*) AS tf FROM (SELECT rec_id, unnest({S.words(text)}) AS term FROM {source}) GROUP BY ALL"


_P1 = f"""WITH tf AS ({_tf("concat_ws(' ', ar.matn, en, narrator)")}),
  st AS (SELECT term, sum(tf)::BIGINT AS gf, count(*) AS df, sum(tf * ln(tf)) AS tlt FROM tf GROUP BY term), n AS (SELECT count(*) AS n FROM {_R})"""
_P7 = f"""WITH tf AS ({_tf("coalesce(en, '')")}), st AS (SELECT term, sum(tf)::BIGINT AS tf, count(*) AS df FROM tf GROUP BY term),
  b AS (SELECT max(c) AS c FROM (SELECT arg_max(dfcutoff, built) AS c FROM manifest GROUP BY collection, first_book, last_book)),
  m AS (SELECT st.*, CASE WHEN df > floor((SELECT c FROM b) * (SELECT count(*) FROM {_R})) THEN 'common' WHEN df = 1 THEN 'rare' END AS mark FROM st)"""
_SPANS = " UNION ALL ".join(
    f"SELECT DISTINCT '{f}' AS fld, rec_id, substr(t, i, 120) AS s FROM (SELECT rec_id, t, unnest(range(1, length(t) - 118)) AS i FROM (SELECT rec_id, ar.{f} AS t FROM {_R}) WHERE length(t) >= 120)"
    for f in ("matn", "sanad")
)

ORACLES: dict[str, str] = {
    "p1_scores": f"""{_P1} SELECT rec_id, term, tf.tf, df, gf, round(ln(1 + tf.tf) * (1 - CASE WHEN n > 1 THEN (ln(gf) - tlt / gf) / ln(n) ELSE 0 END), 6) AS score FROM tf JOIN st USING (term), n""",
    "p1_found": f"{_P1} SELECT rec_id, term FROM tf JOIN st USING (term) WHERE tf.tf >= 3 AND df BETWEEN 2 AND 8",
    "p2_found": f"WITH w AS ({_SPANS}), c AS (SELECT fld, s FROM w GROUP BY ALL HAVING count(*) > 1) SELECT DISTINCT fld, rec_id FROM w SEMI JOIN c USING (fld, s)",
    "p4_found": f"""WITH s AS (SELECT rec_id, list_distinct({S.words("concat_ws(' ', ar.matn, en)")}) AS w FROM {_R}), k AS (SELECT rec_id, w, len(w) AS n FROM s WHERE len(w) > 0),
        p AS (SELECT a.rec_id AS rec_a, b.rec_id AS rec_b, a.n + b.n AS both_, len(list_intersect(a.w, b.w)) AS c FROM k a JOIN k b ON a.rec_id < b.rec_id AND least(a.n, b.n) * 10 >= greatest(a.n, b.n) * 7)
        SELECT rec_a, rec_b FROM p WHERE c * 10 >= (both_ - c) * 7""",
    "p6_found": """WITH d AS (SELECT max(x) AS d FROM (SELECT arg_max(vectors.dims, built) AS x FROM manifest GROUP BY collection, first_book, last_book)),
        v AS (SELECT vec_id, any_value(list_transform(q, lambda x: x::DOUBLE * sign(scale))) AS q FROM vectors, d WHERE len(q) = d.d AND scale <> 0 AND list_bool_or(list_transform(q, lambda x: x <> 0)) GROUP BY vec_id),
        c AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.q, b.q) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id),
        t AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(c, 9) DESC, b) AS nth FROM c)
        SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM t WHERE nth <= 10 AND c >= 0.9""",
    "p7_counts": f"{_P7} SELECT * FROM m",
    "p7_found": f"{_P7} SELECT term, mark FROM m WHERE mark IS NOT NULL",
    "p9_found": f"""WITH i AS (SELECT item_id, {S.words("coalesce(text, '')")} AS w FROM eval_items), d AS (SELECT doc_id, {S.words("coalesce(text, '')")} AS w FROM documents),
        g AS (SELECT DISTINCT item_id, array_to_string(w[s:s + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS s FROM i WHERE len(w) >= 12)),
        h AS (SELECT doc_id, array_to_string(w[s:s + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS s FROM d WHERE len(w) >= 12))
        SELECT DISTINCT doc_id, item_id FROM h JOIN g USING (g)""",
}
