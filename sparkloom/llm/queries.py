"""The queries that ``__spark_entry__`` registers for this subpackage: each operator over its whole table.

``QUERIES`` maps a name to a function of (spark, sf_dir); ``ORACLE_SQL`` has DuckDB SQL for those that SQL can express.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import chat, clusters, decontaminate, hardnegatives, langid, linededup, media, packing, passages, simhash, tokencount, toxicity, urlfilter

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary files lie; they aren't part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.fit(docs.where("NOT held_out"))
    named = langid.identify(docs, model)
    return named.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat.mismatched_replies(table(spark, sf_dir, "conversations"))

    def runs(mask: str) -> Column:
        return F.array_join(F.transform(mask, lambda m: F.concat(F.when(m["train"], "+").otherwise("-"), m["chars"].cast("string"))), " ")

    return chat.format_preferences(pairs).withColumns({m: runs(m) for m in ("chosen_mask", "rejected_mask")})


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, urlfilter.RULE_SCHEMA)
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", "n_items", "item_words", "matched_words", "coverage", "longest_tile")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    thinned = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return thinned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"), ("quality", "toxic"))
    return toxicity.score(docs, chain).select("doc_id", "p_quality", "p_toxic", F.col("is_toxic").alias("toxic_pred"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.encode_jpeg(table(spark, sf_dir, "documents"))
    stored = stored.withColumns({"media_bytes": F.length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    read = media.decode_jpeg(stored, keep=("n_bytes", "media_bytes", "media_sha256"))
    return read.select(
        "doc_id",
        "n_bytes",
        F.length("thumbnail").cast("long").alias("payload_bytes"),
        F.sha2("thumbnail", 256).alias("payload_sha256"),
        F.crc32(F.substring("thumbnail", -32, 32)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.format_string("%dx%d:%s", "width", "height", "thumbnail_hash").alias("feature"),
        "images",
    )


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = passages.without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op12_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardnegatives.mine(table(spark, sf_dir, "embeddings"), label=label, anchor=F.col("vec_id") % 50 == 0)


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_language_id": op3_language_id,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_url_filters": op5_url_filters,
    "op6_line_dedup": op6_line_dedup,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_toxicity": op8_toxicity,
    "op9_token_counts": op9_token_counts,
    "op10_media_columns": op10_media_columns,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_hard_negative_mining": op12_hard_negative_mining,
    "op13_centroid_clustering": op13_centroid_clustering,
}

ORACLE_SQL = {
    "op4_chat_formatting": r"""
        WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
        n AS (
          SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k,
                 '<|im_start|>' || coalesce(role, 'unknown') || chr(10) AS header,
                 replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10) AS body
          FROM t),
        c AS (
          SELECT conv_id, count(*) AS turns, coalesce(max(k) FILTER (role = 'assistant'), 0) AS last FROM n GROUP BY conv_id),
        reply AS (SELECT n.conv_id, text, header, body FROM n JOIN c ON n.conv_id = c.conv_id AND n.k = c.last),
        j AS (
          SELECT c.*, o.conv_id IS NOT NULL AS has_other, r.header AS h, r.body AS b, o.header AS oh, o.body AS ob,
                 CASE WHEN last = 0 THEN turns
                      WHEN o.conv_id IS NOT NULL AND o.text IS NOT DISTINCT FROM r.text THEN last
                      ELSE last - 1 END AS prefix_turns
          FROM c LEFT JOIN reply r ON r.conv_id = c.conv_id LEFT JOIN reply o ON o.conv_id = xor(c.conv_id, 1)),
        p AS (
          SELECT j.conv_id, coalesce(string_agg(header || body, '' ORDER BY k) FILTER (k <= prefix_turns), '') AS prompt
          FROM j JOIN n USING (conv_id) GROUP BY j.conv_id)
        SELECT conv_id, prefix_turns::INTEGER AS prefix_turns, prompt,
               CASE WHEN prefix_turns < last THEN h || b ELSE '' END AS chosen,
               CASE WHEN prefix_turns < last THEN '-' || length(h) || ' +' || length(b) ELSE '' END AS chosen_mask,
               CASE WHEN prefix_turns < last AND has_other THEN oh || ob ELSE '' END AS rejected,
               CASE WHEN prefix_turns < last AND has_other THEN '-' || length(oh) || ' +' || length(ob) ELSE '' END AS rejected_mask
        FROM j JOIN p USING (conv_id)
    """,
    "op5_url_filters": r"""
        WITH parts AS (
          SELECT page_id,
                 CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
          FROM pages),
        hp AS (
          SELECT page_id,
                 translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
          FROM parts),
        rules(r_host, r_path, r_verdict) AS (
          VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        hits AS (
          SELECT hp.*, r_host || r_path AS rule, r_verdict,
                 row_number() OVER (PARTITION BY page_id ORDER BY length(r_host || r_path) DESC NULLS LAST, length(r_host) DESC) AS k
          FROM hp LEFT JOIN rules
            ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
        SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(r_verdict, 'allow') AS verdict
        FROM hits WHERE k = 1
    """,
    "op6_line_dedup": r"""
        WITH l AS (
          SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                 unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
          FROM documents),
        k AS (
          SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
          FROM l),
        f AS (
          SELECT key, max(doc_id) AS last_id FROM k WHERE length(key) >= 20
          GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        m AS (SELECT k.*, (f.key IS NOT NULL AND k.doc_id < f.last_id) AS gone FROM k LEFT JOIN f USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id
    """,
}
