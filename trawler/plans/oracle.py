"""DuckDB SQL for every registered query that SQL can express, over one prefix of common tables."""

from __future__ import annotations

from trawler.functions import features as X
from trawler.functions.text import MAX_TOKEN_LENGTH, MIN_TOKEN_LENGTH, STOPWORDS
from trawler.plans.registry import CUTS, GRID, WEIGHT_VARIANTS
from trawler.plans.views import DEPTH, FIELD_WEIGHTS, POOL_BM25, POOL_DENSE, QUERY_TERMS, RM3

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in STOPWORDS)


def _simple(text: str) -> str:
    return f"regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+')"


def _not_stop(tokens: str) -> str:
    return f"list_filter({tokens}, lambda t: t NOT IN ({_STOP}))"


def _kept(text: str) -> str:
    tests = f"length(t) BETWEEN {MIN_TOKEN_LENGTH} AND {MAX_TOKEN_LENGTH} AND NOT regexp_full_match(t, '[0-9]+')"
    return f"list_filter({_simple(text)}, lambda t: t NOT IN ({_STOP}) AND {tests})"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '\\s+'), lambda t: t <> '')"


def r6(expr: str, alias: str | None = None) -> str:
    return f"floor(({expr}) * 1e6 + 0.5e0) / 1e6 AS {alias or expr}"


def _bm25(k1: float = 1.2, b: float = 0.75) -> str:
    return f"ln((n_docs - df + 0.5e0) / (df + 0.5e0) + 1) * tf * ({k1}e0 + 1) / (tf + {k1}e0 * (1 - {b}e0 + {b}e0 * length / avgdl))"


def _ranked(scored: str, by: str = "qid", k: int = DEPTH, value: str = "score", tie: str = "doc_id") -> str:
    return (
        f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {by} ORDER BY floor({value} * 1e6 + 0.5e0) / 1e6 DESC, {tie}) AS INTEGER) AS rank "
        f"FROM ({scored})) WHERE rank <= {k}"
    )


def _scored(terms: str, postings: str, lex: str, lengths: str, stats: str, weight: str) -> str:
    return (
        f"SELECT qid, doc_id, sum({weight}) AS score FROM {terms} JOIN {postings} USING (term) JOIN {lex} USING (term) JOIN {lengths} USING (doc_id), {stats} GROUP BY qid, doc_id"
    )


def _index(name: str, tokens: str, lengths: str) -> str:
    """The four tables of an index from (doc_id, term, n) and (doc_id, length)."""
    return f"""
{name}postings AS MATERIALIZED (SELECT term, doc_id, CAST(sum(n) AS INTEGER) AS tf FROM ({tokens}) GROUP BY 1, 2),
{name}lengths AS MATERIALIZED ({lengths}),
{name}stats AS (SELECT count(*) AS n_docs, avg(length) AS avgdl FROM {name}lengths),
{name}lex AS MATERIALIZED (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM {name}postings GROUP BY 1)"""


def _weighted(name: str, weights: dict[str, int]) -> str:
    rows = " UNION ALL ".join(f"SELECT doc_id, unnest({f}_terms) AS term, {w} AS n FROM fields" for f, w in weights.items() if w > 0)
    length = " + ".join(f"{w} * len({f}_terms)" for f, w in weights.items())
    return _index(name, rows, f"SELECT doc_id, CAST({length} AS INTEGER) AS length FROM fields")


_RM3 = f"""
fb AS (SELECT qid, doc_id, score, score / sum(score) OVER (PARTITION BY qid) AS share FROM ({_ranked(_scored("qterms", "wpostings", "wlex", "wlengths", "wstats", _bm25()), k=RM3["fb_docs"])})),
fbmodel AS (SELECT qid, term, sum(CAST(tf AS DOUBLE) / length * share) AS p FROM fb JOIN wpostings USING (doc_id) JOIN wlengths USING (doc_id) GROUP BY 1, 2),
fbheavy AS ({_ranked("SELECT * FROM fbmodel", k=RM3["fb_terms"], value="p", tie="term")}),
fbown AS (SELECT qid, term, {RM3["orig_weight"]}e0 / count(*) OVER (PARTITION BY qid) AS weight FROM qterms),
expanded AS MATERIALIZED (SELECT qid, term, sum(weight) AS weight FROM (
  SELECT * FROM fbown UNION ALL SELECT qid, term, (1 - {RM3["orig_weight"]}e0) * p / sum(p) OVER (PARTITION BY qid) FROM fbheavy) GROUP BY 1, 2)"""

_NORM = lambda run: f"coalesce(nullif((SELECT max(score) FROM {run} m WHERE m.qid = c.qid), 0), 1e0)"

PREFIX = rf"""
WITH corpus AS MATERIALIZED (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, regexp_extract(text, '^[^.\n]*', 0) AS title, text, concat_ws(' ', lang, source) AS keywords,
    concat_ws(' ', nullif(regexp_extract(text, '^[^.\n]*', 0), ''), nullif(text, ''), nullif(concat_ws(' ', lang, source), '')) AS content
  FROM documents WHERE text IS NOT NULL),
analyzed AS MATERIALIZED (SELECT doc_id, {_kept("content")} AS terms FROM corpus),
queries AS MATERIALIZED (SELECT item_id AS qid, array_to_string(bag, ' ') AS qtext, bag FROM (SELECT item_id, {_kept("text")}[1:{QUERY_TERMS}] AS bag FROM benchmark)),
qpos AS (SELECT qid, unnest(bag) AS term, unnest(range(len(bag))) AS pos FROM queries),
qterms AS MATERIALIZED (SELECT qid, term, min(pos) AS pos FROM qpos GROUP BY 1, 2),
qrels AS MATERIALIZED (
  SELECT item_id AS qid, d.doc_id, CASE WHEN d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 2 ELSE 1 END AS rel
  FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
{_index("", "SELECT doc_id, unnest(terms) AS term, 1 AS n FROM analyzed", "SELECT doc_id, CAST(len(terms) AS INTEGER) AS length FROM analyzed")},
fields AS MATERIALIZED (SELECT doc_id, {_kept("title")} AS title_terms, {_kept("text")} AS text_terms, {_kept("keywords")} AS keywords_terms FROM corpus),
{_weighted("w", FIELD_WEIGHTS)},
hits AS (SELECT qid, term, doc_id, tf FROM qterms JOIN postings USING (term)),
mor AS MATERIALIZED (SELECT qid, doc_id, count(*) AS matched FROM hits GROUP BY 1, 2),
wanted AS (SELECT qid, count(*) AS wanted FROM qterms GROUP BY 1),
mand AS MATERIALIZED (SELECT qid, doc_id FROM mor JOIN wanted USING (qid) WHERE matched = wanted),
bm25 AS MATERIALIZED ({_ranked(_scored("qterms", "postings", "lex", "lengths", "stats", _bm25()))}),
fw AS MATERIALIZED ({_ranked(_scored("qterms", "wpostings", "wlex", "wlengths", "wstats", _bm25()))}),
{_RM3},
rm3 AS MATERIALIZED ({_ranked(_scored("expanded", "wpostings", "wlex", "wlengths", "wstats", "weight * (" + _bm25() + ")"))}),
ddocs AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE text IS NOT NULL)),
dqueries AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings WHERE vec_id IN (SELECT qid FROM queries)),
dense AS MATERIALIZED ({_ranked("SELECT qid, doc_id, list_inner_product(q.vec, d.vec) AS score FROM dqueries q, ddocs d", k=POOL_DENSE)}),
c4 AS MATERIALIZED (
  SELECT qid, doc_id, coalesce(rel, 0) AS relevance, CAST(max(p) AS INTEGER) AS is_pool FROM (
    SELECT qid, doc_id, 1 AS p FROM bm25 WHERE rank <= {POOL_BM25} UNION ALL SELECT qid, doc_id, 0 FROM qrels) LEFT JOIN qrels USING (qid, doc_id) GROUP BY 1, 2, 3),
c6 AS MATERIALIZED (
  SELECT qid, doc_id, coalesce(rel, 0) AS relevance, CAST(max(p) AS INTEGER) AS is_pool FROM (
    SELECT qid, doc_id, 1 AS p FROM bm25 WHERE rank <= {POOL_BM25} UNION ALL SELECT qid, doc_id, 1 FROM fw WHERE rank <= {POOL_BM25}
    UNION ALL SELECT qid, doc_id, 1 FROM rm3 WHERE rank <= {POOL_BM25} UNION ALL SELECT qid, doc_id, 0 FROM qrels) LEFT JOIN qrels USING (qid, doc_id) GROUP BY 1, 2, 3),
ch AS MATERIALIZED (
  SELECT qid, doc_id, coalesce(rel, 0) AS relevance, CAST(max(p) AS INTEGER) AS is_pool FROM (
    SELECT qid, doc_id, 1 AS p FROM bm25 WHERE rank <= {POOL_BM25} UNION ALL SELECT qid, doc_id, 1 FROM dense
    UNION ALL SELECT qid, doc_id, 0 FROM qrels) LEFT JOIN qrels USING (qid, doc_id) GROUP BY 1, 2, 3),
qmean AS (SELECT qid, coalesce(avg(CASE WHEN term IS NULL THEN NULL ELSE coalesce(df, 0) END), 0e0) AS mean_df FROM queries LEFT JOIN qpos USING (qid) LEFT JOIN lex USING (term) GROUP BY 1),
qmeanw AS (SELECT qid, coalesce(avg(CASE WHEN term IS NULL THEN NULL ELSE coalesce(df, 0) END), 0e0) AS mean_df FROM queries LEFT JOIN qpos USING (qid) LEFT JOIN wlex USING (term) GROUP BY 1),
dfields AS MATERIALIZED (
  SELECT doc_id, title AS title_text, {_words("title")} AS title, lower(keywords) AS kw, CAST(len({_words("text")}) AS DOUBLE) AS doc_len,
    list_distinct({_words("concat_ws(' ', title, text, keywords)")}) AS words FROM corpus),
pairs AS (SELECT qid, doc_id FROM c4 UNION SELECT qid, doc_id FROM c6 UNION SELECT qid, doc_id FROM ch),
bigrams AS (SELECT qid, bag, list_distinct([bag[i] || ' ' || bag[i + 1] for i in range(1, len(bag))]) AS qbi FROM queries),
tbigrams AS (SELECT *, list_distinct([title[i] || ' ' || title[i + 1] for i in range(1, len(title))]) AS tbi FROM dfields),
feats AS MATERIALIZED (
  SELECT c.qid, c.doc_id, coalesce(b.score, 0e0) AS f_bm25, coalesce(f.score, 0e0) AS f_field_weights, coalesce(r.score, 0e0) AS f_rm3,
    coalesce(b.score, 0e0) / {_NORM("bm25")} AS f_bm25_norm, coalesce(f.score, 0e0) / {_NORM("fw")} AS f_fw_norm, coalesce(r.score, 0e0) / {_NORM("rm3")} AS f_rm3_norm,
    CAST(coalesce(b.rank, {X.MISSING_RANK}) AS DOUBLE) AS f_bm25_rank, CAST(len(q.bag) AS DOUBLE) AS f_query_length, m.mean_df AS f_mean_df, d.doc_len AS f_doc_length,
    coalesce(len(list_filter(q.bag, lambda x: list_contains(d.title, x))) / nullif(CAST(len(q.bag) AS DOUBLE), 0), 0) AS f_title_overlap,
    CAST(len(list_filter(q.bag, lambda x: contains(d.kw, x))) AS DOUBLE) AS f_keyword_match,
    coalesce(len(list_intersect(list_distinct(q.bag), list_distinct(d.title))) / nullif(CAST(len(list_distinct(list_concat(q.bag, d.title))) AS DOUBLE), 0), 0) AS f_title_jaccard,
    coalesce(len(list_intersect(q.qbi, d.tbi)) / nullif(CAST(len(q.qbi) AS DOUBLE), 0), 0) AS f_title_bigram_overlap,
    coalesce((list_position(list_transform(d.title, lambda t: list_contains(q.bag, t)), true) - 1) / nullif(CAST(len(d.title) AS DOUBLE), 0), 1e0) AS f_title_match_pos,
    coalesce(len(list_intersect(list_distinct(q.bag), d.words)) / nullif(CAST(len(list_distinct(q.bag)) AS DOUBLE), 0), 0) AS f_query_coverage,
    CAST(len(list_filter(q.bag, lambda x: contains(lower(d.title_text), x))) > 0 AS DOUBLE) AS f_title_exact_match,
    coalesce(list_inner_product(dq.vec, dd.vec), 0e0) AS f_dense_sim, coalesce(1e0 / dr.rank, 0e0) AS f_dense_rrank
  FROM pairs c JOIN bigrams q USING (qid) JOIN qmeanw m USING (qid) JOIN tbigrams d USING (doc_id)
    LEFT JOIN bm25 b USING (qid, doc_id) LEFT JOIN fw f USING (qid, doc_id) LEFT JOIN rm3 r USING (qid, doc_id)
    LEFT JOIN dqueries dq USING (qid) LEFT JOIN ddocs dd USING (doc_id) LEFT JOIN dense dr USING (qid, doc_id)),
run100 AS (SELECT qid, doc_id, rank FROM bm25 WHERE rank <= {POOL_BM25}),
ideal AS (SELECT qid, sum(rel / log2(place + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc_id) AS place FROM qrels) WHERE place <= 100 GROUP BY 1),
nd AS (SELECT qid, coalesce(dcg / idcg, 0e0) AS ndcg FROM ideal LEFT JOIN (SELECT qid, sum(rel / log2(rank + 1)) AS dcg FROM run100 JOIN qrels USING (qid, doc_id) GROUP BY 1) USING (qid)),
ndf AS (SELECT qid, coalesce(dcg / idcg, 0e0) AS ndcg FROM ideal LEFT JOIN (SELECT qid, sum(rel / log2(rank + 1)) AS dcg FROM fw JOIN qrels USING (qid, doc_id) WHERE rank <= 100 GROUP BY 1) USING (qid)),
deltas AS (SELECT a.ndcg - b.ndcg AS d FROM ndf a JOIN nd b USING (qid))
"""


def _feature_rows(cands: str, names: tuple[str, ...], *more: str) -> str:
    extra = "".join(f"c.{m}, " for m in more)
    return f"SELECT c.qid, c.doc_id, {extra}{', '.join(r6(n) for n in names)} FROM {cands} c JOIN feats USING (qid, doc_id)"


def _recall(pools: dict[str, str]) -> str:
    rows = " UNION ALL ".join(f"SELECT '{name}' AS pool, qid, doc_id FROM ({sql})" for name, sql in pools.items())
    names = ", ".join(f"('{n}')" for n in pools)
    return f"""
, pool_rows AS (SELECT DISTINCT * FROM ({rows})), pool_names(pool) AS (VALUES {names}),
pool_wanted AS (SELECT pool, qid, count(*) AS wanted FROM qrels, pool_names GROUP BY 1, 2),
pool_got AS (SELECT pool, qid, count(*) AS got FROM pool_rows JOIN qrels USING (qid, doc_id) GROUP BY 1, 2),
pool_size AS (SELECT pool, qid, count(*) AS size FROM pool_rows GROUP BY 1, 2),
pool_each AS (SELECT pool, coalesce(got, 0) / CAST(wanted AS DOUBLE) AS recall, coalesce(size, 0) AS size FROM pool_wanted LEFT JOIN pool_got USING (pool, qid) LEFT JOIN pool_size USING (pool, qid))
SELECT pool, {r6("avg(recall)", "mean_recall")}, {r6("quantile_cont(recall, 0.5)", "median_recall")}, {r6("avg(size)", "mean_size")} FROM pool_each GROUP BY 1"""


def _cut(run: str, k: int) -> str:
    return f"SELECT qid, doc_id FROM {run} WHERE rank <= {k}"


def _grid() -> str:
    return " UNION ALL ".join(
        f"SELECT {k1}e0 AS k1, {b}e0 AS b, qid, doc_id, {r6('score')}, rank FROM ({_ranked(_scored('qterms', 'postings', 'lex', 'lengths', 'stats', _bm25(k1, b)), k=10)})" for k1, b in GRID
    )


def _variants() -> str:
    out, rows = "", []
    for i, w in enumerate(WEIGHT_VARIANTS):
        out += "," + _weighted(f"v{i}", dict(zip(FIELD_WEIGHTS, w, strict=True)))
        ranked = _ranked(_scored("qterms", f"v{i}postings", f"v{i}lex", f"v{i}lengths", f"v{i}stats", _bm25()), k=10)
        rows.append(f"SELECT '{'/'.join(map(str, w))}' AS weights, qid, doc_id, {r6('score')}, rank FROM ({ranked})")
    return out + " ".join(["\n", " UNION ALL ".join(rows)])


def _run(run: str) -> str:
    return f"SELECT qid, doc_id, {r6('score')}, rank FROM {run}"


def _scored_run(weight: str, conjunctive: bool) -> str:
    terms = "(SELECT qid, term, tf, doc_id FROM hits JOIN mand USING (qid, doc_id))" if conjunctive else "(SELECT qid, term, tf, doc_id FROM hits)"
    return _run("(" + _ranked(f"SELECT qid, doc_id, sum({weight}) AS score FROM {terms} JOIN lex USING (term) JOIN lengths USING (doc_id), stats GROUP BY qid, doc_id", k=100) + ")")


_TFIDF = "(1 + ln(tf)) * ln(CAST(n_docs AS DOUBLE) / df)"
_TRIMMED = "nullif(trim(title), ''), nullif(trim(text), ''), nullif(trim(keywords), '')"
_LEXICAL, _NORMS, _CONTENT = ("f_bm25", "f_field_weights", "f_rm3", "f_bm25_rank"), ("f_bm25_norm", "f_fw_norm", "f_rm3_norm"), X.FEATURE_ORDER[7:]
_REPEATED = "trim(concat({}))".format(", ".join(f"CASE WHEN trim({f}) <> '' THEN repeat(trim({f}) || ' ', {w}) ELSE '' END" for f, w in zip(("title", "text", "keywords"), (3, 1, 2), strict=True)))

_BODIES = {
    "scan_corpus": "SELECT id, CAST(length(title) AS INTEGER) AS title_chars, sha256(text) AS text_sha256, keywords FROM corpus",
    "scan_query_lines": "SELECT qtext AS query FROM queries WHERE qtext <> ''",
    "scan_queries": "SELECT lpad(CAST(qid AS VARCHAR), 3, '0') AS qid, qtext FROM queries WHERE qtext <> ''",
    "scan_qrels": "SELECT CAST(qid AS VARCHAR) AS qid, CAST(doc_id AS VARCHAR) AS doc_id, rel FROM qrels",
    "scan_run": "SELECT CAST(qid AS VARCHAR) AS qid, CAST(doc_id AS VARCHAR) AS doc_id, rank FROM run100",
    "lookup_fields": "SELECT doc_id, title, CAST(length(text) AS INTEGER) AS text_chars, keywords FROM corpus WHERE doc_id IN (SELECT doc_id FROM qrels)",
    "distinct_ids": "SELECT doc_id FROM run100 UNION SELECT doc_id FROM qrels",
    "full_content": "SELECT doc_id, CAST(length(content) AS INTEGER) AS chars, sha256(content) AS content_sha256 FROM corpus",
    "contents_flat": f"SELECT doc_id, sha256(concat_ws(' ', {_TRIMMED})) AS contents_sha256 FROM corpus",
    "contents_weighted": f"SELECT doc_id, CAST(length(c) AS INTEGER) AS chars, sha256(c) AS contents_sha256 FROM (SELECT doc_id, {_REPEATED} AS c FROM corpus)",
    "embed_text": "SELECT doc_id, substring('passage: ' || trim(title || '. ' || text || ' ' || keywords), 1, 2000) AS embed_text FROM corpus",
    "tokenize_simple": f"SELECT doc_id, len(t) AS n_tokens, sha256(coalesce(array_to_string(t, ' '), '')) AS tokens_sha256 FROM (SELECT doc_id, {_simple('content')} AS t FROM corpus)",
    "remove_stopwords": f"SELECT doc_id, len(t) AS n_tokens, sha256(coalesce(array_to_string(t, ' '), '')) AS tokens_sha256 FROM (SELECT doc_id, {_not_stop(_simple('content'))} AS t FROM corpus)",
    "analyze_docs": "SELECT doc_id, len(terms) AS n_terms, sha256(coalesce(array_to_string(terms, ' '), '')) AS terms_sha256 FROM analyzed",
    "analyze_queries": "SELECT qid, qtext, coalesce(t, '') AS terms FROM queries LEFT JOIN (SELECT qid, string_agg(term, ' ' ORDER BY pos) AS t FROM qterms GROUP BY 1) USING (qid)",
    "assign_doc_ids": "SELECT id, doc_id, row_number() OVER (ORDER BY id) - 1 AS internal_id FROM corpus",
    "term_freq": "SELECT term, doc_id, tf FROM postings",
    "doc_length": "SELECT doc_id, length FROM lengths",
    "merge_postings": "SELECT term, doc_id, CAST(count(*) AS INTEGER) AS tf FROM (SELECT doc_id, unnest(title_terms) AS term FROM fields UNION ALL SELECT doc_id, unnest(text_terms) FROM fields) GROUP BY 1, 2",
    "lexicon": "SELECT term, df, cf FROM lex",
    "inverted_lists": "SELECT term, string_agg(doc_id || ':' || tf, ' ' ORDER BY doc_id) AS list FROM postings GROUP BY 1",
    "index_stats": "SELECT count(*) AS number_of_lists, round(sum(df) / CAST(count(*) AS DOUBLE), 2) AS average_list_size FROM lex",
    "doc_stats": f"SELECT n_docs, {r6('avgdl')} FROM stats",
    "postings_lookup": "SELECT term, doc_id, tf FROM postings WHERE term IN (SELECT term FROM qterms)",
    "lexicon_df": "SELECT term, coalesce(df, 0) AS df FROM (SELECT DISTINCT term FROM qterms UNION SELECT 'zzunknownzz') LEFT JOIN lex USING (term)",
    "match_and": "SELECT qid, doc_id FROM mand",
    "match_or": "SELECT qid, doc_id, matched FROM mor",
    "match_stats": """
SELECT s.qid, n_terms, known_terms, postings_in_lists, coalesce(n_or, 0) AS n_or, coalesce(n_and, 0) AS n_and, known_terms < n_terms AS early_terminated
FROM (SELECT qid, count(*) AS n_terms, count(df) AS known_terms, CAST(coalesce(sum(df), 0) AS BIGINT) AS postings_in_lists FROM qterms LEFT JOIN lex USING (term) GROUP BY 1) s
LEFT JOIN (SELECT qid, count(*) AS n_or FROM mor GROUP BY 1) USING (qid) LEFT JOIN (SELECT qid, count(*) AS n_and FROM mand GROUP BY 1) USING (qid)""",
    "tfidf_and": _scored_run(_TFIDF, True),
    "tfidf_or": _scored_run(_TFIDF, False),
    "bm25_and": _scored_run(_bm25(), True),
    "bm25_or": _scored_run(_bm25(), False),
    "bm25_k1_b_grid": _grid(),
    "bm25_field_weighted": _variants(),
    "rm3_expand": f"SELECT qid, term, {r6('weight')} FROM expanded",
    "rm3_search": _run("rm3") + " WHERE rank <= 100",
    "query_mean_df": f"SELECT qid, {r6('mean_df')} FROM qmean",
    "topk_per_query": _run("bm25") + " WHERE rank <= 7",
    "bm25_top1000": _run("bm25"),
    "rerank_topk": f"""
SELECT qid, doc_id, {r6("prediction")}, CAST(rank AS INTEGER) AS rank FROM (
  SELECT qid, doc_id, prediction, row_number() OVER (PARTITION BY qid ORDER BY floor(prediction * 1e6 + 0.5e0) / 1e6 DESC, floor(f_bm25 * 1e6 + 0.5e0) / 1e6 DESC, doc_id) AS rank
  FROM (SELECT c.qid, c.doc_id, f_bm25, f_bm25_norm + f_dense_sim AS prediction FROM ch c JOIN feats USING (qid, doc_id) WHERE is_pool = 1)) WHERE rank <= 100""",
    "pool_bm25": "SELECT qid, doc_id FROM run100",
    "train_candidates": "SELECT qid, doc_id, relevance, is_pool FROM c4",
    "pool_union3": "SELECT qid, doc_id, relevance, is_pool FROM c6",
    "pool_hybrid": "SELECT qid, doc_id, relevance, is_pool FROM ch",
    "hard_negatives": "SELECT qid, doc_id, rank FROM bm25 WHERE rank BETWEEN 20 AND 60 AND (qid, doc_id) NOT IN (SELECT qid, doc_id FROM qrels)",
    "scan_embeddings": f"SELECT doc_id, len(vec) AS dim, {r6('list_inner_product(vec, vec)', 'norm2')} FROM ddocs",
    "dense_sim": f"SELECT qid, doc_id, {r6('coalesce(list_inner_product(q.vec, d.vec), 0e0)', 'sim')} FROM run100 LEFT JOIN dqueries q USING (qid) LEFT JOIN ddocs d USING (doc_id)",
    "dense_topk": _run("dense"),
    "features_lexical": _feature_rows("c4", _LEXICAL),
    "features_content": _feature_rows("c4", _CONTENT),
    "features_norm": _feature_rows("c4", _NORMS),
    "features_dense": _feature_rows("ch", ("f_dense_sim", "f_dense_rrank")),
    "features_interaction": f"""
, sims AS (SELECT c.qid, c.doc_id, f_bm25_norm, f_rm3_norm, floor(f_dense_sim * 1e6 + 0.5e0) / 1e6 AS sim FROM ch c JOIN feats USING (qid, doc_id)),
per AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY sim DESC, doc_id) AS DOUBLE) AS f_dense_rank, max(sim) OVER (PARTITION BY qid) AS top,
  avg(sim) OVER (PARTITION BY qid) AS mean, stddev_pop(sim) OVER (PARTITION BY qid) AS spread FROM sims),
inter AS (SELECT qid, doc_id, f_dense_rank, CASE WHEN top <> 0 THEN sim / top ELSE 0e0 END AS f_dense_norm, CASE WHEN spread > 1e-9 THEN (sim - mean) / spread ELSE 0e0 END AS f_dense_z,
  sim * f_bm25_norm AS f_dense_x_bm25norm, sim * f_rm3_norm AS f_dense_x_rm3norm FROM per)
SELECT qid, doc_id, {", ".join(r6(c) for c in ("f_dense_rank", "f_dense_norm", "f_dense_z", "f_dense_x_bm25norm", "f_dense_x_rm3norm"))} FROM inter""",
    "features_v1": _feature_rows("c6", ("f_bm25", "f_field_weights", "f_rm3", "f_query_length", "f_mean_df"), "relevance"),
    "features_v3": _feature_rows(
        "c4", ("f_bm25", "f_field_weights", "f_rm3", "f_bm25_norm", "f_bm25_rank", "f_query_length", "f_mean_df", "f_doc_length", "f_title_overlap", "f_title_exact_match", "f_keyword_match"), "relevance"
    ),
    "features_v4": _feature_rows("c4", X.FEATURE_ORDER, "relevance"),
    "features_v6": _feature_rows("c6", X.FEATURE_ORDER, "relevance", "is_pool"),
    "features_hybrid": _feature_rows("ch", X.HYBRID_ORDER, "relevance", "is_pool"),
    "pair_score": f"""
SELECT qid, doc_id, {r6("coalesce(len(list_intersect(list_distinct(q.bag), " + _words("substring(c.text, 1, 1500)") + "[1:320])) / nullif(CAST(len(list_distinct(q.bag)) AS DOUBLE), 0), 0)", "f_ce")}
FROM run100 JOIN queries q USING (qid) JOIN corpus c USING (doc_id)""",
    "ndcg_per_query": f"SELECT qid, {r6('ndcg')} FROM nd",
    "ndcg_mean": f"SELECT count(*) AS n_queries, {r6('avg(ndcg)', 'ndcg')} FROM nd",
    "compare_runs": f"""
SELECT count(*) AS n, {r6("avg(d)", "mean_delta")}, {r6("CASE WHEN sqrt(var_samp(d) / count(*)) > 0 THEN avg(d) / sqrt(var_samp(d) / count(*)) END", "t")},
  count(*) FILTER (WHERE d > 1e-9) AS wins, count(*) FILTER (WHERE abs(d) <= 1e-9) AS ties, count(*) FILTER (WHERE d < -1e-9) AS losses FROM deltas""",
    "recall_hybrid": _recall({"bm25": _cut("bm25", POOL_BM25), "dense": _cut("dense", POOL_DENSE), "union": _cut("bm25", POOL_BM25) + " UNION " + _cut("dense", POOL_DENSE)}),
    "recall_at_cuts": _recall(
        {f"{n}@{k}": _cut(n, k) for n in ("bm25", "fw", "rm3") for k in CUTS} | {f"union@{k}": " UNION ".join(_cut(n, k) for n in ("bm25", "fw", "rm3")) for k in CUTS}
    ),
}

ORACLE_SQL = {name: PREFIX + body for name, body in _BODIES.items()}
