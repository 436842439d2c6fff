"""The queries over the training-data operators, with their fixed result columns, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm import bpe, exact_dedup, language_id, lm_scoring, mixing, near_dedup, pii, spotsigs, tool_calls, url_filter
from tarmac.llm.common import table


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [pii.count_of("base", k).alias(f"n_{kind}") for k, kind in enumerate(pii.BASE_KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.rendered("base"), 256).alias("base_sha256"), pii.rendered("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def public_vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[bytes, str]:
    """Ranks and pre-token pattern of a public tokenizer."""
    import public_tokenizers

    return bpe.vocabulary(public_tokenizers.path(name)), public_tokenizers.PATTERN


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents"), *public_vocabulary(), decode_too=True)
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = tool_calls.link(*tool_calls.from_turns(table(spark, sf_dir, "conversations")))
    return linked.withColumn("json_sha256", F.sha2("json", 256)).drop("json")


#: The list of op8: (entry_id, listed_on, action, kind, pattern, category).
LIST_ENTRIES = [
    (1, "2024-01-05", "add", "host", "spam-farm.example.org", "spam"),
    (2, "2024-05-01", "remove", "host", "spam-farm.example.org", "spam"),
    (3, "2024-09-10", "add", "host", "spam-farm.example.org", "spam"),
    (4, "2024-02-01", "add", "host", "cheap-pills.example.com", "pharma"),
    (5, "2024-02-01", "add", "host", "cheap-pills.example.net", "pharma"),
    (6, "2024-07-15", "remove", "host", "cheap-pills.example.net", "pharma"),
    (7, "2024-03-01", "add", "host", "casino-win.example.net", "gambling"),
    (8, "2024-03-01", "add", "host", "adult-x.example.com", "adult"),
    (9, "2024-06-01", "add", "host", "adult-x.example.com", "adult-strict"),
    (10, "2024-04-01", "add", "prefix", "tionsh.example.net/es", "spam"),
    (11, "2024-08-01", "remove", "prefix", "tionsh.example.net/es", "spam"),
    (12, "2024-04-01", "add", "host", "example.org", "watch"),
    (13, "2024-04-20", "add", "host", "thther.example.org", "allow"),
    (14, "2024-10-01", "remove", "host", "example.org", "watch"),
    (15, "2024-05-05", "add", "prefix", "blog.cheap-pills.example.com/en", "allow"),
    (16, "2024-05-05", "add", "host", "tionsh.example.net", "watch"),
    (17, "2024-05-05", "remove", "host", "tionsh.example.net", "watch"),
]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int"))
    captures = table(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetched_on"))
    names = ("entry_id", "listed_on", "action", "kind", "pattern", "category")
    entries = spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, e, strict=True))) for e in LIST_ENTRIES))))
    entries = entries.withColumns({"entry_id": F.col("entry_id").cast("long"), "listed_on": F.col("listed_on").cast("date")})
    return url_filter.evaluate(captures, entries).withColumn("fetched_on", F.col("fetched_on").cast("string"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = lm_scoring.held_out("doc_id", 7, 2)
    scored = lm_scoring.score(table(spark, sf_dir, "documents"), held)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = language_id.held_out()
    parser = language_id.fit(docs, ~held)
    found = language_id.identify(docs, parser)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


QUERIES = {
    "op1_spotsigs": op1_spotsigs,
    "op2_pii": op2_pii,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_source_mixing": op6_source_mixing,
    "op7_tool_calls": op7_tool_calls,
    "op8_url_filter": op8_url_filter,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_language_id": op10_language_id,
}

SQL = {
    "op5_exact_dedup": """
        WITH low AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
        ), g AS (
            SELECT doc_id, sha256(t) AS text_sha256, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM low
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
    """,
    "op6_source_mixing": r"""
        WITH sized AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                ('0x' || substring(md5(doc_id || ':7'), 1, 15))::BIGINT AS place
            FROM documents
        ), s AS (
            SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS position FROM sized GROUP BY source
        ), w AS (
            SELECT *, [3, 1, 2][((position - 1) % 3 + 1)::INT] AS weight, 2 * source_size AS cap FROM s
        ), l AS (
            SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
                - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
                / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, position ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
            FROM w
        ), f AS (
            SELECT *, (SELECT level FROM l AS m WHERE m.level * m.weight <= m.cap ORDER BY m.cap::DOUBLE / m.weight, m.position LIMIT 1) AS fill FROM l
        ), t AS (
            SELECT source, source_size, coalesce(least(cap::DOUBLE, fill * weight), cap::DOUBLE) AS target FROM f
        ), u AS (
            SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t
        ), d AS (
            SELECT doc_id, size, source_size, target, whole, floor(target + 0.5)::BIGINT - whole * source_size AS extra,
                sum(size) OVER (PARTITION BY sized.source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS low
            FROM sized JOIN u ON sized.source IS NOT DISTINCT FROM u.source
        )
        SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, extra - low)))::BIGINT AS taken FROM d
    """,
    "op7_tool_calls": """
        WITH RECURSIVE asked AS (
            SELECT conv_id || '-' || turn AS call_id, conv_id, turn::BIGINT AS turn, CASE WHEN role = 'system' THEN 'configure' ELSE 'answer' END AS name, text
            FROM conversations WHERE role IS DISTINCT FROM 'assistant'
        ), calls AS (
            SELECT a.*, CASE WHEN b.call_id IS NOT NULL THEN b.call_id ELSE c.call_id END AS parent_id
            FROM asked a LEFT JOIN asked b ON b.call_id = a.conv_id || '-' || (a.turn - 2) LEFT JOIN asked c ON c.call_id = a.conv_id || '-' || (a.turn - 1)
        ), d AS (
            SELECT call_id, 0::BIGINT AS depth FROM calls WHERE parent_id IS NULL
            UNION ALL SELECT calls.call_id, d.depth + 1 FROM calls JOIN d ON calls.parent_id = d.call_id
        ), results AS (
            SELECT conv_id || '-' || (turn - 1) AS call_id, turn::BIGINT AS result_turn, text AS result FROM conversations WHERE role = 'assistant'
        ), j AS (
            SELECT coalesce(calls.call_id, results.call_id) AS call_id, conv_id, turn, name, parent_id, depth, result_turn, text, result,
                (calls.call_id IS NOT NULL)::BIGINT AS n_calls, (results.call_id IS NOT NULL)::BIGINT AS n_results
            FROM (calls JOIN d USING (call_id)) AS calls FULL JOIN results ON calls.call_id = results.call_id
        ), p AS (
            SELECT *, CASE WHEN n_calls = 0 THEN 'no call' ELSE concat_ws(',',
                CASE WHEN text IS NULL THEN 'missing:text' WHEN length(text) < 1 OR length(text) > CASE WHEN name = 'answer' THEN 4000 ELSE 2000 END THEN 'range:text' END,
                CASE WHEN turn < 0 OR turn > CASE WHEN name = 'answer' THEN 1000000 ELSE 0 END THEN 'range:turn' END) END AS problems
            FROM j
        )
        SELECT call_id, conv_id, turn, name, parent_id, depth, result_turn, n_calls, n_results, n_calls > 0 AND n_results > 0 AS linked, problems = '' AS valid, problems,
            sha256('{"arguments":' || CASE WHEN n_calls = 0 THEN 'null' ELSE '{"text":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"turn":' || turn || '}' END
                || ',"id":' || to_json(call_id)::VARCHAR || ',"name":' || coalesce(to_json(name)::VARCHAR, 'null') || ',"parent":' || coalesce(to_json(parent_id)::VARCHAR, 'null')
                || ',"result":' || coalesce(to_json(result)::VARCHAR, 'null') || ',"turn":' || coalesce(turn::VARCHAR, 'null') || '}') AS json_sha256
        FROM p
    """,
    "op8_url_filter": r"""
        WITH e(entry_id, listed_on, action, kind, pattern, category) AS (VALUES
            """ + ",\n            ".join(str(x) for x in LIST_ENTRIES) + r"""
        ), i AS (
            SELECT *, lead(listed_on) OVER (PARTITION BY kind, pattern ORDER BY listed_on, entry_id) AS valid_to FROM e
        ), active AS (
            SELECT * FROM i WHERE action = 'add' AND (valid_to IS NULL OR valid_to > listed_on)
        ), c AS (
            SELECT page_id, url, strftime(DATE '2024-01-01' + ((page_id * 37) % 366)::INT, '%Y-%m-%d') AS fetched_on, count(*) AS copies,
                rtrim(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.') AS host,
                lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*(/[^?#]*)', 1)) AS path
            FROM pages GROUP BY ALL
        ), m AS (
            SELECT c.*, entry_id, category, length(pattern) AS size, listed_on,
                row_number() OVER (PARTITION BY page_id, url, fetched_on ORDER BY length(pattern) DESC, listed_on DESC, entry_id DESC) AS k,
                count(entry_id) OVER (PARTITION BY page_id, url, fetched_on) AS n_active
            FROM c LEFT JOIN active ON listed_on <= fetched_on AND (valid_to IS NULL OR fetched_on < valid_to)
                AND CASE WHEN kind = 'host' THEN host = pattern OR ends_with(host, '.' || pattern)
                    ELSE host || path = pattern OR starts_with(host || path, pattern || '/') END
        )
        SELECT page_id, url, fetched_on, host, copies, n_active, entry_id, category, coalesce(category <> 'allow', false) AS blocked FROM m WHERE k = 1
    """,
}
