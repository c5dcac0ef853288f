"""The corpus operators as named queries over the given tables, with the
parameters meant for production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelight.llm import ann, bag_search, centroids, html, langid, line_dedup, lm, mixing, ngram_join, packing, token_counts, tokens, topk, urlfilter
from sitelight.llm.common import fold_of, table

Query = Callable[[SparkSession, str], DataFrame]


SEQUENCE_LENGTH = 2048


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = tokens.pieces(table(spark, sf_dir, "documents"), tokens.tokenizer_path(), SEQUENCE_LENGTH)
    digests = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digests, SEQUENCE_LENGTH)


def op2_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op3_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (fold_of("doc_id", 5) == 1).alias("held_out"), "text")
    return lm.score(docs, docs.where(~F.col("held_out")))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold_of("doc_id", 4) == 2)
    model = langid.fit(docs.where(~F.col("held_out")), langid.vocabulary_path())
    return langid.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op6_line_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.groups(table(spark, sf_dir, "documents"), width=3, percent=90)


#: Shares of tokens that the mixture should have by domain.
MIXTURE = {"good": 0.94, "junk": 0.04, "toxic": 0.02}


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, domain) of the labelled documents."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "good")
    return table(spark, sf_dir, "labels").select("doc_id", domain.alias("domain"))


def op8_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated, names, report = mixing.mix(table(spark, sf_dir, "documents"), domains(spark, sf_dir), MIXTURE)
    shares = [F.get("posterior", F.lit(i)).alias(f"p_{name}") for i, name in enumerate(names)]
    return rated.select("doc_id", "tokens", *shares, "rate", "copies", F.lit(report["converged"]).alias("converged"))


#: Host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.exact_top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10, scale=1024)


CENTROIDS, ROUNDS, CLUSTER_SEED, DIMENSIONS = 8, 10, 3, 64


def op11_laesa_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _, _ = centroids.cluster(table(spark, sf_dir, "embeddings"), k=CENTROIDS, rounds=ROUNDS, seed=CLUSTER_SEED, dim=DIMENSIONS, scale=1024)
    return found


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), token_counts.model_path(), limit=4096)


def op13_bag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def queries() -> dict[str, Query]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_graph_neighbours": op2_graph_neighbours,
        "op3_bloom_lm": op3_bloom_lm,
        "op4_html_extraction": op4_html_extraction,
        "op5_language_id": op5_language_id,
        "op6_line_chunk_dedup": op6_line_chunk_dedup,
        "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
        "op8_soft_mixing": op8_soft_mixing,
        "op9_url_filter": op9_url_filter,
        "op10_exact_top_k": op10_exact_top_k,
        "op11_laesa_clusters": op11_laesa_clusters,
        "op12_token_counts": op12_token_counts,
        "op13_bag_search": op13_bag_search,
    }


def _cluster_sql() -> str:
    """Plain Lloyd rounds, one after the other."""
    distance = "CAST(list_sum(list_transform(range(1, len(v.vector) + 1), lambda i: (v.vector[i] - c.vector[i]) * (v.vector[i] - c.vector[i]))) AS BIGINT)"
    steps = []
    for i in range(ROUNDS + 1):
        steps.append(f"""
        a{i} AS MATERIALIZED (
            SELECT v.n, min({{'distance': {distance}, 'cluster': c.cluster}}) AS nearest FROM v, c{i} c GROUP BY v.n
        )""")
        if i < ROUNDS:
            steps.append(f"""
        c{i + 1} AS MATERIALIZED (
            SELECT c.cluster, coalesce(new.vector, c.vector) AS vector
            FROM c{i} c LEFT JOIN (
                SELECT cluster, list((total - ((total % n) + n) % n) // n ORDER BY i) AS vector
                FROM (SELECT nearest.cluster AS cluster, i, CAST(sum(v.vector[i]) AS BIGINT) AS total, count(*) AS n
                      FROM a{i} JOIN v USING (n), range(1, {DIMENSIONS} + 1) t(i) GROUP BY ALL)
                GROUP BY cluster
            ) new USING (cluster)
        )""")
    return f"""
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS vector
            FROM embeddings
            WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), c0 AS MATERIALIZED (
            SELECT CAST(row_number() OVER (ORDER BY sha256('{CLUSTER_SEED}:' || vec_id) NULLS LAST, vector) - 1 AS INTEGER) AS cluster, vector
            FROM v QUALIFY cluster < {CENTROIDS}
        ), {",".join(steps)}
        SELECT vec_id, nearest.cluster AS cluster, nearest.distance AS distance,
               CAST(sum(nearest.distance) OVER (PARTITION BY nearest.cluster) AS BIGINT) AS cluster_inertia,
               CAST(sum(nearest.distance) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(c.vector, ',')) AS centroid_sha256
        FROM a{ROUNDS} JOIN v USING (n) JOIN c{ROUNDS} c ON c.cluster = nearest.cluster
    """


SQL = {
    "op9_url_filter": """
        WITH rules(rule_host, rule_path, rule_verdict) AS (
            VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                   ('net', '/es/', 'block'), ('net', '/fr/', 'block')
        ), split AS (
            SELECT row_number() OVER () AS n, page_id,
                   translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages
        )
        SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(rule_verdict, 'allow') AS verdict
        FROM split LEFT JOIN rules
          ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        QUALIFY row_number() OVER (PARTITION BY n ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC, rule_verdict DESC) = 1
    """,
    "op10_exact_top_k": """
        WITH v AS (
            SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS vector
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.n, q.vec_id AS query_id, c.vec_id,
                   CAST(list_inner_product(CAST(q.vector AS DOUBLE[]), CAST(c.vector AS DOUBLE[])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.n <> q.n AND len(c.vector) = len(q.vector)
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
               vec_id, score
        FROM scored
        QUALIFY rank <= 10
    """,
    "op11_laesa_clusters": _cluster_sql(),
    "op13_bag_search": r"""
        WITH d AS MATERIALIZED (
            SELECT * FROM (
                SELECT row_number() OVER () AS uid, doc_id,
                       regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS terms
                FROM documents WHERE text IS NOT NULL
            ) WHERE len(terms) > 0
        ), corpus AS (
            SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d
        ), length_of AS (
            SELECT uid, doc_id, 100 - 25 + (25 * len(terms) * n_docs) // n_terms AS m FROM d, corpus
        ), tf AS MATERIALIZED (
            SELECT uid, term, count(*) AS tf FROM (SELECT uid, unnest(terms) AS term FROM d) GROUP BY ALL
        ), weight AS (
            SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
            FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), corpus
        ), asked AS (
            SELECT n, item_id, term, count(*) AS times FROM (
                SELECT row_number() OVER () AS n, item_id,
                       unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term
                FROM benchmark WHERE text IS NOT NULL
            ) GROUP BY ALL
        ), scored AS (
            SELECT n, item_id, uid, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
            FROM asked JOIN weight USING (term) JOIN tf USING (term) JOIN length_of USING (uid)
            GROUP BY n, item_id, uid, doc_id
        )
        SELECT item_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM scored WHERE score > 0
        QUALIFY rank <= 20
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
