"""The registered queries over the corpus tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, compression, fingerprint, jaccard, lm, mixing, packing, tokencount, urls
from .common import fold, table


def _held_out(modulus: int, rest: int):
    return F.coalesce(fold("doc_id", modulus) == rest, F.lit(False))


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_next_document(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"), n=5, percent=75)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenized_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)
    return packing.pack(pieces, capacity=2048)


def op4_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(3.0, 1.0, 2.0), budget=1.5, cap=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", _held_out(4, 2))
    model = compression.fit_languages(docs.where("not held_out"))
    found = compression.language_id(docs.select("doc_id", "text", "held_out"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged_pages(table(spark, sf_dir, "pages"), urls.RULES)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", _held_out(7, 2))
    model = lm.train(docs.where("not held_out"))
    scored = lm.scores(docs, model, ["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model[2]).cast("long").alias("train_tokens"), "base_score", "score")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", _held_out(5, 0))
    model = compression.fit_quality(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    return compression.quality_scores(docs, model, threshold=0.3).select("doc_id", "held_out", "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_document_fingerprints, op2_ngram_jaccard_join, op3_best_fit_packing, op4_mixing_sources, op5_language_id, op6_nearest_neighbours, op7_url_filters, op8_lm_scoring, op9_token_counts, op10_quality_classifier)
}

_OP2 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT i, j FROM p JOIN n x ON x.doc_id = i JOIN n y ON y.doc_id = j WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT i, j FROM l UNION ALL SELECT j, i FROM l),
r AS (SELECT i AS a, i AS b FROM e UNION SELECT r.a, e.j FROM r JOIN e ON e.i = r.b),
c AS (SELECT a, min(b) AS m FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.m, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _rule_sql(host: str, path: str) -> str:
    ordered = sorted((r for _, r in urls.RULES), key=lambda r: (-len(r), r))
    fits = (f"WHEN ({host} = '{r.split('/')[0]}' OR ends_with({host}, '.{r.split('/')[0]}')) AND starts_with({path}, '/{r.partition('/')[2]}') THEN '{r}'" for r in ordered)
    return f"CASE {' '.join(fits)} END"


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_HOST, _PATH = r"'^(?s:.*?)://([^/?#]*)'", r"'^(?s:.*?)://[^/?#]*([^?#]*)'"
_CODE = "CASE WHEN {r} IN ('example.net/en/', 'org/fr/') THEN 2 WHEN {r} IS NOT NULL THEN 1 ELSE 0 END"


def _judged_sql(url: str) -> str:
    return _CODE.format(r="(" + _rule_sql(f"coalesce(translate(regexp_extract({url}, {_HOST}, 1), {_AZ}), '')", f"coalesce(regexp_extract({url}, {_PATH}, 1), '')") + ")")


def _node_sql(url: str) -> str:
    whole = f"regexp_replace({url}, '#(?s:.*)$', '')"
    rest = f"regexp_extract({whole}, '^(?s:.*?)://[^/?#]*((?s:.*))$', 1)"
    return f"CASE WHEN contains({url}, '://') THEN translate(regexp_extract({whole}, '^((?s:.*?))://', 1), {_AZ}) || '://' || translate(regexp_extract({whole}, {_HOST}, 1), {_AZ}) || CASE WHEN {rest} = '' THEN '/' ELSE {rest} END END"


def _undotted_sql(path: str) -> str:
    fold = r"list_reduce(list_prepend('', list_slice(string_split(P, '/'), 2, 1000000000)), lambda done, x: CASE WHEN x = '.' THEN done WHEN x = '..' THEN regexp_replace(done, '/[^/]*$', '') ELSE done || '/' || x END)"
    return (fold + r" || CASE WHEN regexp_matches(P, '/\.{1,2}$') THEN '/' ELSE '' END").replace("P", path)


_OP7 = rf"""
WITH RECURSIVE tag AS (
  SELECT url, list_transform(regexp_extract_all(html, {_sql(urls._TAG)}), lambda t: regexp_replace(t, '\s+', ' ', 'g')) AS t FROM pages WHERE html IS NOT NULL),
raw AS (
  SELECT url, replace(unnest(list_concat(
    list_transform(list_filter(t, lambda x: regexp_matches(x, {_sql(urls._CANONICAL)})), lambda x: regexp_extract(x, {_sql(urls._HREF)}, 1)),
    list_transform(list_filter(t, lambda x: regexp_matches(x, {_sql(urls._REFRESH)})), lambda x: regexp_extract(x, {_sql(urls._URL)}, 1)))), '&amp;', '&') AS t FROM tag),
part AS (
  SELECT url, t, regexp_replace(url, '[?#](?s:.*)$', '') AS base, regexp_replace(t, '[?#](?s:.*)$', '') AS own, regexp_extract(t, '[?#](?s:.*)$') AS rest FROM raw WHERE t <> ''),
piece AS (
  SELECT *, regexp_extract(base, '^((?s:.*?))://', 1) AS scheme, regexp_extract(base, {_HOST}, 1) AS host, regexp_extract(base, '^(?s:.*?)://[^/?#]*((?s:.*))$', 1) AS path FROM part),
full_ AS (
  SELECT *, scheme || '://' || host AS site, CASE WHEN starts_with(own, '/') THEN own ELSE CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || own END AS whole_path FROM piece),
link AS (
  SELECT url, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN NOT contains(url, '://') OR starts_with(t, '#') OR regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with(t, '//') THEN scheme || ':' || t WHEN starts_with(t, '?') THEN base || t ELSE site || ({_undotted_sql("whole_path")}) || rest END AS t FROM full_),
ends AS (SELECT {_node_sql("url")} AS i, {_node_sql("t")} AS j, {_judged_sql("url")} AS of_i, {_judged_sql("t")} AS of_j FROM link),
l AS (SELECT * FROM ends WHERE i <> j),
e AS (SELECT i, j FROM l UNION SELECT j, i FROM l),
own AS (SELECT n, max(c) AS c FROM (SELECT i AS n, of_i AS c FROM l UNION ALL SELECT j, of_j FROM l) GROUP BY 1),
reach AS (SELECT i AS a, i AS b FROM e UNION SELECT reach.a, e.j FROM reach JOIN e ON e.i = reach.b),
alias AS (SELECT a, max(c) AS d FROM reach JOIN own ON n = b GROUP BY 1),
u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, {_HOST}, 1), {_AZ}), '') AS host, coalesce(regexp_extract(url, {_PATH}, 1), '') AS path, {_node_sql("url")} AS n FROM pages),
ruled AS (SELECT *, {_rule_sql("host", "path")} AS rule FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN d = 1 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN alias ON alias.a = n
"""

ORACLES = {"op2_ngram_jaccard_join": _OP2, "op7_url_filters": _OP7}
