"""The queries of this folder's operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from steadyframes.llm import bpe, collocations, decontaminate, jaccard, lmscore, media, nearest, pii, tokencount, tokenfile, toolcalls, toxicity, yinyang


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.digest(table(spark, sf_dir, "conversations"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"), words=3, percent=90)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.digest(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang.digest(table(spark, sf_dir, "embeddings"))


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_tool_calls, op2_ngram_jaccard, op3_lm_scoring, op4_decontamination, op5_pii, op6_token_file, op7_toxicity, op8_media, op9_token_counts, op10_byte_bpe,
        op11_centroids, op12_nearest, op13_collocations,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _phrases_sql(least: int = 10, percent: int = 50, top: int = 2000) -> str:
    """Counts of all phrases as text, cut by cut."""
    gram = lambda k: f"SELECT lang, array_to_string(list_slice(w, i, i + {k - 1}), ' ') AS g, {k} AS k FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM w)"
    big = lambda a, l, r: f"CAST((1000000::HUGEINT * {a} * {a}) // ({l}::HUGEINT * {r}) AS BIGINT)"
    return f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
c AS MATERIALIZED (SELECT lang, k, g, count(*) AS a FROM ({" UNION ALL ".join(gram(k) for k in (1, 2, 3))}) GROUP BY ALL HAVING count(*) >= {least}),
s AS (SELECT lang, k, g, a, string_split(g, ' ') AS v FROM c WHERE k > 1),
cuts AS (SELECT lang, k, g, a, t, array_to_string(v[:t], ' ') AS gl, array_to_string(v[t + 1:], ' ') AS gr FROM (SELECT *, unnest(range(1, k)) AS t FROM s)),
scored AS (SELECT cuts.*, x.a AS l, y.a AS r, {big("cuts.a", "x.a", "y.a")} AS score FROM cuts JOIN c x ON x.lang = cuts.lang AND x.g = gl JOIN c y ON y.lang = cuts.lang AND y.g = gr),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, t) = 1),
inside AS (SELECT lang, g, max(a) AS longer FROM (SELECT lang, array_to_string(v[1:2], ' ') AS g, a FROM s WHERE k = 3 UNION ALL SELECT lang, array_to_string(v[2:3], ' '), a FROM s WHERE k = 3) GROUP BY ALL)
SELECT lang, rank, g AS phrase, a, l, r, n, score FROM (SELECT best.*, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.g) AS rank FROM best
 LEFT JOIN inside ON inside.lang = best.lang AND inside.g = best.g WHERE k = 3 OR longer IS NULL OR 100 * longer < {percent} * a) JOIN n USING (lang) WHERE rank <= {top}
"""


def _clusters_sql(k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:") -> str:
    """Plain rounds: all distances, then floors of means. Sums of squares of these integers are exact in doubles."""

    def assigned(t: int) -> str:
        return f"""a{t} AS MATERIALIZED (SELECT r, vec_id, x, d, c FROM (SELECT r, vec_id, x, j.c AS c, CAST(xx - 2 * list_dot_product(x, y) + list_dot_product(y, y) AS BIGINT) AS d FROM v, c{t} j)
 QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"""

    def next_(t: int) -> str:
        return f"""m{t} AS (SELECT c, pos, CAST(sum(CAST(e AS BIGINT)) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS e, unnest(range({dims})) AS pos FROM a{t}) GROUP BY ALL),
y{t} AS (SELECT c, list(CAST((s - (((s % n) + n) % n)) // n AS DOUBLE) ORDER BY pos) AS y FROM m{t} GROUP BY 1),
c{t + 1} AS MATERIALIZED (SELECT c{t}.c, coalesce(y{t}.y, c{t}.y) AS y FROM c{t} LEFT JOIN y{t} ON y{t}.c = c{t}.c)"""

    steps = ", ".join(f"{assigned(t)}, {next_(t)}" for t in range(rounds))
    return f"""
WITH u AS (SELECT vec_id, list_transform(embedding, lambda e: floor({scale} * CAST(e AS DOUBLE))) AS x FROM embeddings
 WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims}),
v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, x, list_dot_product(x, x) AS xx FROM u),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, x) - 1 AS c, x AS y FROM (SELECT sha256('{salt}' || CAST(vec_id AS VARCHAR)) AS h, x FROM v) QUALIFY c < {k}),
{steps}, {assigned(rounds)},
s AS (SELECT c, CAST(sum(d) AS BIGINT) AS cluster_inertia FROM a{rounds} GROUP BY 1)
SELECT vec_id, CAST(a.c AS INT) AS cluster, d AS distance, cluster_inertia, (SELECT CAST(sum(d) AS BIGINT) FROM a{rounds}) AS inertia, sha256(array_to_string(list_transform(y, lambda e: CAST(CAST(e AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} a JOIN s ON s.c = a.c JOIN c{rounds} z ON z.c = a.c
"""


_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: The others have no form in SQL that keeps whole texts in reach; each is tested against brute force or a library.
SQL: dict[str, str] = {
    "op4_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
k AS (SELECT *, least(10, len(w)) AS k FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM k)),
dw AS (SELECT r, k, p, array_to_string(list_slice(w, p, p + k - 1), ' ') AS win FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM k) WHERE len(w) >= k)),
h AS (SELECT r, p, dw.k, item_id FROM dw JOIN iw ON iw.k = dw.k AND iw.win = dw.win),
n AS (SELECT r, count(DISTINCT spot) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS spot FROM h) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
""",
    "op11_centroids": _clusters_sql(),
    "op13_collocations": _phrases_sql(),
}
