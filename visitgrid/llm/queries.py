"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from visitgrid.llm import (
    collocations, decontam, extraction, jaccard, language, lm, merkle, packing, quality, secrets, tokens, toxicity, warc)
from visitgrid.llm.common import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


@query("op1_secret_scan")
def op1(spark, sf_dir):
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


@query("op2_decontamination")
def op2(spark, sf_dir):
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_token_counts")
def op3(spark, sf_dir):
    return tokens.token_counts(table(spark, sf_dir, "documents"))


@query("op4_toxicity")
def op4(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_quality_rules")
def op5(spark, sf_dir):
    return quality.quality_rules(table(spark, sf_dir, "documents"))


@query("op6_warc", warc.SQL)
def op6(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op7_language_id")
def op7(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


@query("op8_packing")
def op8(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"))


@query("op9_lm_scores")
def op9(spark, sf_dir):
    return lm.lm_scores(table(spark, sf_dir, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shared shingles counted by a join, links by exact whole numbers, groups by reachability.
JACCARD_SQL = rf"""WITH RECURSIVE
w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
l AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {jaccard.SIZE} THEN [array_to_string(ws, ' ')] ELSE
  list_distinct(list_transform(range(1, len(ws) - {jaccard.SIZE} + 2), lambda i: array_to_string(ws[i:i + {jaccard.SIZE} - 1], ' '))) END AS ss FROM w),
s AS (SELECT doc_id, unnest(ss) AS s FROM l),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
k AS (SELECT x, y FROM c JOIN l a ON x = a.doc_id JOIN l b ON y = b.doc_id WHERE 100 * n >= {jaccard.PERCENT} * (len(a.ss) + len(b.ss) - n)),
e AS (SELECT x, y FROM k UNION SELECT y, x FROM k),
r AS (SELECT doc_id AS d, doc_id AS m FROM l UNION SELECT r.d, e.y FROM r JOIN e ON r.m = e.x)
SELECT l.doc_id, len(ss)::BIGINT AS n_shingles, g.m AS component_id FROM l JOIN (SELECT d, min(m) AS m FROM r GROUP BY 1) g ON l.doc_id = g.d"""


@query("op10_jaccard_join", JACCARD_SQL)
def op10(spark, sf_dir):
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


@query("op11_collocations")
def op11(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op12_merkle_manifest", merkle.SQL)
def op12(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents"))


@query("op13_html_extraction")
def op13(spark, sf_dir):
    return extraction.extracted(table(spark, sf_dir, "pages"))
