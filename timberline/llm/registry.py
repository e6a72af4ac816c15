"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from timberline.llm import bpe, covertree, licenses, media, oracles, packing, secrets, sharding, simhash, spelling, substring, toxicity, urlfilter, vectorcodes
from timberline.llm.common import documents


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), width=4, lanes=1, radius=4, similarity=None, distinct=False)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), n_shards=40)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.without_repeats(documents(spark, sf_dir)).select("doc_id", "removed_sentences", "text")


def op6_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.95)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_packing, op2_simhash, op3_sharding, op4_url_filter, op5_substring, op6_cover_tree, op7_bpe, op8_media, op9_toxicity, op10_secrets,
        op11_licenses, op12_vector_codes, op13_spelling,
    )
}


def url_filter_sql(levels: int = 4) -> str:
    """DuckDB SQL of ``op4_url_filter``, level by level like the tree itself; the tables' paths have two segments, so few levels are opened."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    rules = sorted(urlfilter.RULES, key=lambda r: (-len(r[0]), r[0]))
    base, weight, least = urlfilter.PRIOR[0] / sum(urlfilter.PRIOR), sum(urlfilter.PRIOR), urlfilter.MIN_LABELS

    def case(pick: int) -> str:
        tests = []
        for r in rules:
            domain, _, start = r[0].partition("/")
            tests.append(f"WHEN (host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '/{start}') THEN '{r[pick]}'")
        return "CASE " + " ".join(tests) + " END"

    def estimate(b: str, n: str, prior: str) -> str:
        return f"(({b})::DOUBLE + {weight}::DOUBLE * {prior}) / (({n})::DOUBLE + {weight}::DOUBLE)"

    def down(purity: str, n: str, urls: str) -> str:
        return f"({base}::DOUBLE + ({n})::DOUBLE / ({urls})::DOUBLE * ({purity} - {base}::DOUBLE))"

    opens = f"(l >= {least} AND (l < n OR (b > 0 AND b < l)))"
    shape = f"array_to_string(list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') OR length(x) > {urlfilter.MAX_SEGMENT} THEN '*' ELSE x END), '/')"
    sums = "sum(n)::BIGINT AS n, sum(l)::BIGINT AS l, sum(b)::BIGINT AS b"
    sql = [
        f"parsed AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{parts}', 1), ''), '{upper}', '{lower}') AS host, coalesce(regexp_extract(url, '{parts}', 2), '') AS path FROM pages)",
        f"judged AS (SELECT *, {case(0)} AS rule, {case(1)} AS says, coalesce({shape}, '') AS shape FROM parsed)",
        "shapes AS (SELECT host, shape, count(*) AS n, count(says) AS l, count(CASE WHEN says = 'block' THEN 1 END) AS b FROM judged GROUP BY host, shape)",
        "named AS (SELECT *, regexp_replace(host, ':[0-9]*$', '') AS name FROM shapes)",
        f"hosts AS (SELECT host, CASE WHEN regexp_matches(name, '^[0-9.]*$') THEN name ELSE regexp_extract(name, '([^.]*[.])?[^.]*$') END AS domain, {sums} FROM named GROUP BY host, name)",
        "domains AS (SELECT domain, sum(n) AS dn, sum(l) AS dl, sum(b) AS db FROM hosts GROUP BY domain)",
        f"h1 AS (SELECT hosts.*, {estimate('b', 'l', down(estimate('db', 'dl', f'{base}::DOUBLE'), 'dl', 'dn'))} AS purity FROM hosts JOIN domains USING (domain))",
        f"n0 AS (SELECT shapes.*, '' AS template, purity, h1.l AS labels, {down('purity', 'h1.l', 'h1.n')} AS prior, (h1.l >= {least} AND (h1.l < h1.n OR (h1.b > 0 AND h1.b < h1.l))) AS open FROM shapes JOIN h1 USING (host))",
    ]
    for k in range(levels):
        sql += [
            f"o{k} AS (SELECT *, coalesce(string_split(shape, '/')[{k + 1}], '') AS s FROM n{k} WHERE open)",
            f"k{k} AS (SELECT host, template, s, {sums}, any_value(prior) AS prior FROM o{k} GROUP BY host, template, s)",
            f"w{k} AS (SELECT host, template, sum(l)::DOUBLE AS wl, sum(b)::DOUBLE AS wb, count(CASE WHEN s NOT IN ('', '*') THEN 1 END) > {urlfilter.MAX_CHILDREN} AS wide FROM k{k} GROUP BY host, template)",
            f"d{k} AS (SELECT *, CASE WHEN l < {least} OR (wide AND s = '*') THEN {urlfilter.UNPROVEN} WHEN abs(b::DOUBLE / l::DOUBLE - wb / wl) > {urlfilter.Z} * sqrt(wb / wl * (1 - wb / wl) / l::DOUBLE) THEN sign(b::DOUBLE / l::DOUBLE - wb / wl)::INT ELSE 0 END AS side FROM k{k} JOIN w{k} USING (host, template))",
            f"e{k} AS (SELECT *, CASE WHEN side = {urlfilter.UNPROVEN} AND wide AND s <> '' THEN '*' ELSE s END AS piece FROM d{k})",
            f"p{k} AS (SELECT host, template, side, sum(n) AS pn, sum(l) AS pl, sum(b) AS pb FROM e{k} GROUP BY host, template, side)",
            f"q{k} AS (SELECT host, template, piece, {opens} AND piece <> '' AS opens FROM (SELECT host, template, piece, {sums} FROM e{k} GROUP BY host, template, piece) t)",
            f"r{k} AS (SELECT e.host, e.template, e.s, e.piece, {estimate('pb', 'pl', 'e.prior')} AS purity, pl::BIGINT AS labels, pn, opens FROM e{k} e JOIN p{k} USING (host, template, side) JOIN q{k} q ON q.host = e.host AND q.template = e.template AND q.piece = e.piece)",
            f"n{k + 1} AS (SELECT o.host, o.shape, o.n, o.l, o.b, o.template || '/' || r.piece AS template, r.purity, r.labels, {down('r.purity', 'r.labels', 'r.pn')} AS prior, r.opens AS open FROM o{k} o JOIN r{k} r ON r.host = o.host AND r.template = o.template AND r.s = o.s)",
        ]
    done = " UNION ALL ".join(f"SELECT host, shape, template, purity FROM n{k}" + ("" if k == levels else " WHERE NOT open") for k in range(levels + 1))
    return (
        f"WITH {', '.join(sql)} SELECT page_id, host, path, rule, coalesce(says, CASE WHEN purity > {urlfilter.REJECT_OVER} THEN 'block' ELSE 'allow' END) AS verdict,"
        f" CASE WHEN template = '' THEN '/' ELSE template END AS template, round(purity, 9) AS purity FROM judged JOIN ({done}) t USING (host, shape)"
    )


COVER_TREE_SQL = """WITH RECURSIVE fit AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM fit a JOIN fit b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS node, vec_id AS other FROM embeddings UNION SELECT r.node, l.v FROM reach r JOIN links l ON r.other = l.u),
n AS (SELECT u, count(*) AS n_links FROM links GROUP BY u), c AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings LEFT JOIN n ON vec_id = u JOIN c ON vec_id = node"""

#: The other operators hash, tokenize, fit or walk trees; they are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op4_url_filter": url_filter_sql(),
    "op6_cover_tree": COVER_TREE_SQL,
    "op11_licenses": oracles.licenses_sql(),
    "op12_vector_codes": oracles.vector_codes_sql(),
    "op13_spelling": oracles.spelling_sql(),
}
