"""The registered queries of the numbered operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martspark.llm import (
    bpe,
    fingerprints,
    line_dedup,
    merkle,
    packing,
    pii,
    quality,
    sharding,
    simhash,
    spelling,
    substring_dedup,
    tool_calls,
    toxicity,
)
from martspark.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints.edited_fingerprints(documents(spark, sf_dir))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2048 tokens."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.digest(packing.pack_documents(documents(spark, sf_dir), path))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents that repeat an earlier one, equal or one word apart."""
    return line_dedup.line_report(documents(spark, sf_dir))


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as linked, ordered and checked calls."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return tool_calls.link_calls(*tool_calls.from_conversations(conversations), tool_calls.SCHEMAS)


_OP4_SQL = """
WITH RECURSIVE turns AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
), calls AS (
    SELECT conv_id, turn, CASE role WHEN 'user' THEN 'ask' WHEN 'system' THEN 'configure' ELSE role END AS name, text
    FROM turns WHERE role <> 'assistant'
), chain AS (
    SELECT conv_id, turn, 0 AS level FROM calls c
    WHERE NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2)
    UNION ALL
    SELECT c.conv_id, c.turn, chain.level + 1 FROM chain
    JOIN calls c ON c.conv_id = chain.conv_id AND c.turn = chain.turn + 2
)
SELECT c.conv_id, 'call-' || c.conv_id || '-' || c.turn AS call_id, c.turn, c.name, chain.level,
       CASE WHEN c.name = 'ask' AND length(c.text) < 1 THEN 'arguments.chars: too small'
            WHEN c.name = 'ask' AND length(c.text) > 400 THEN 'arguments.text: too long'
            WHEN c.name NOT IN ('ask', 'configure') THEN 'unknown tool'
            WHEN r.text IS NULL THEN 'no result' ELSE 'linked' END AS status,
       CAST(json_object('arguments', json_object('chars', length(c.text), 'text', c.text),
                        'id', 'call-' || c.conv_id || '-' || c.turn, 'name', c.name,
                        'result', r.text, 'type', 'tool_call') AS VARCHAR) AS message
FROM calls c JOIN chain USING (conv_id, turn)
LEFT JOIN turns r ON r.conv_id = c.conv_id AND r.turn = c.turn + 1 AND r.role = 'assistant'
"""


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of all documents and the groups that their links make."""
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages of 50 words that an earlier one has."""
    return substring_dedup.remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256")
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition measures and verdict of all documents."""
    return quality.score_quality(documents(spark, sf_dir))


def op8_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode_documents(documents(spark, sf_dir), path).select(
        "doc_id",
        (F.length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs, model)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.find_personal_data(documents(spark, sf_dir))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents and the spelling that each one varies."""
    return spelling.spelling_variants(documents(spark, sf_dir))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes."""
    return sharding.report(sharding.assign_shards(documents(spark, sf_dir)))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree over all documents, with proofs checked after some of them were tampered with."""
    return merkle.verify(merkle.manifest(documents(spark, sf_dir))[0])


_OP13_SQL = """
WITH RECURSIVE checks AS (
    SELECT list(c ORDER BY i) AS t FROM (
        SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
        FROM range(256) r(i))
), hit AS (
    SELECT *, coalesce(xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
                                                                       lambda d: CAST(ascii(d) AS BIGINT)),
                                       lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 5 = 0, FALSE) AS tampered
    FROM documents, checks
), fields AS (
    SELECT doc_id, source, tampered,
           coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
           coalesce(strlen("text") || ':' || "text", '-') AS body,
           coalesce(strlen("text") || ':' || translate("text", 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS lowered
    FROM hit
), leaves AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
           count(*) OVER (PARTITION BY source) AS n
    FROM (SELECT doc_id, source, sha256(head || body) AS leaf,
                 CASE WHEN tampered THEN sha256(head || lowered) ELSE sha256(head || body) END AS start FROM fields)
), nodes AS (
    SELECT 0 AS level, source, pos, n, leaf AS node FROM leaves
    UNION ALL
    SELECT level + 1, source, pos // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY pos))
    FROM nodes WHERE n > 1 GROUP BY level, source, pos // 16, n
), subroots AS (
    SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
    FROM nodes WHERE n = 1
), tops AS (
    SELECT 0 AS level, pos, n, subroot AS node FROM subroots
    UNION ALL
    SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY pos))
    FROM tops WHERE n > 1 GROUP BY level, pos // 16, n
), steps AS (
    SELECT l.source, l.pos, s.level AS step,
           coalesce(string_agg(s.node, '' ORDER BY s.pos) FILTER (s.pos < l.pos // CAST(pow(16, s.level) AS BIGINT)), '') AS "left",
           coalesce(string_agg(s.node, '' ORDER BY s.pos) FILTER (s.pos > l.pos // CAST(pow(16, s.level) AS BIGINT)), '') AS "right"
    FROM leaves l JOIN nodes s ON s.source IS NOT DISTINCT FROM l.source AND s.n > 1
         AND s.pos // 16 = l.pos // CAST(pow(16, s.level + 1) AS BIGINT)
    GROUP BY 1, 2, 3
), beyond AS (
    SELECT u.source, 100 + s.level AS step,
           coalesce(string_agg(s.node, '' ORDER BY s.pos) FILTER (s.pos < u.pos // CAST(pow(16, s.level) AS BIGINT)), '') AS "left",
           coalesce(string_agg(s.node, '' ORDER BY s.pos) FILTER (s.pos > u.pos // CAST(pow(16, s.level) AS BIGINT)), '') AS "right"
    FROM subroots u JOIN tops s ON s.n > 1 AND s.pos // 16 = u.pos // CAST(pow(16, s.level + 1) AS BIGINT)
    GROUP BY 1, 2
), paths AS (
    SELECT source, pos, sha256(string_agg("left" || "right", '' ORDER BY step)) AS proof,
           list("left" || '|' || "right" ORDER BY step) AS path
    FROM (SELECT * FROM steps
          UNION ALL SELECT l.source, l.pos, b.step, b."left", b."right"
          FROM leaves l JOIN beyond b ON b.source IS NOT DISTINCT FROM l.source)
    GROUP BY source, pos
), folded AS (
    SELECT l.doc_id, l.leaf, u.subroot, (SELECT node FROM tops WHERE n = 1) AS root, coalesce(p.proof, sha256('')) AS proof_sha256,
           list_reduce([l.start] || coalesce(p.path, []), lambda node, s: sha256(split_part(s, '|', 1) || node || split_part(s, '|', 2))) AS folded_root
    FROM leaves l JOIN subroots u ON u.source IS NOT DISTINCT FROM l.source
         LEFT JOIN paths p ON p.source IS NOT DISTINCT FROM l.source AND p.pos = l.pos
)
SELECT *, folded_root = root AS verified FROM folded
"""


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_document_fingerprints,
        op2_packing,
        op3_line_dedup,
        op4_tool_calls,
        op5_simhash_near_dedup,
        op6_substring_dedup,
        op7_quality_rules,
        op8_bpe_encoding,
        op9_toxicity,
        op10_personal_data,
        op11_spelling_variants,
        op12_sharding,
        op13_merkle_manifest,
    )
}
# The others read texts in ways that SQL cannot express; tests compare them with brute force.
ORACLES: dict[str, str] = {"op4_tool_calls": _OP4_SQL, "op13_merkle_manifest": _OP13_SQL}
