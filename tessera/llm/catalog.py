"""The registered queries of this subpackage, with DuckDB SQL where SQL can state the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.alignment import align
from tessera.llm.ann import nearest_neighbours
from tessera.llm.bm25 import search
from tessera.llm.byte_bpe import bpe_encode
from tessera.llm.chat import REPLY_TOOL, conversation_events, format_chat
from tessera.llm.common import table
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.html_extract import extract
from tessera.llm.langid import identify
from tessera.llm.merkle import audit, build_manifest, strip_line_ends
from tessera.llm.packing import pack_documents
from tessera.llm.pii import detect
from tessera.llm.simhash import simhash_components
from tessera.llm.token_counts import token_counts


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op2_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), F.col("doc_id") % 50 == 0)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chat(conversation_events(table(spark, sf_dir, "conversations")), REPLY_TOOL)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(table(spark, sf_dir, "documents"),
                      public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).drop("ids")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(build_manifest(table(spark, sf_dir, "documents"), claim=strip_line_ends()))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                 public_tokenizers.path("piece_bpe_32k.model")).documents


def op13_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("_id") % 100 == 0)


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_bm25": op2_bm25,
    "op3_chat": op3_chat,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_packing": op6_packing,
    "op7_language": op7_language,
    "op8_html": op8_html,
    "op9_pii": op9_pii,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_merkle": op11_merkle,
    "op12_alignment": op12_alignment,
    "op13_ann": op13_ann,
}

_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: A user turn is a call, an assistant turn the result of the turn before; the rest are messages.
_CHAT = """
    WITH e AS (
        SELECT conv_id, turn, role, text,
               CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
               'call-' || CASE role WHEN 'user' THEN turn WHEN 'assistant' THEN turn - 1 END AS call_id
        FROM conversations),
    calls AS (SELECT conv_id, call_id, min(turn) AS first FROM e WHERE kind = 'call' GROUP BY ALL),
    results AS (SELECT DISTINCT conv_id, call_id FROM e WHERE kind = 'result')
    SELECT e.conv_id, e.turn, e.kind, e.call_id,
           CASE e.kind WHEN 'result' THEN c.first END AS linked_turn,
           CASE e.kind WHEN 'message' THEN e.turn ELSE greatest(e.turn, c.first) END AS position,
           CASE WHEN e.kind = 'result' AND c.first IS NOT NULL THEN 1 ELSE 0 END::INT AS level,
           CASE WHEN e.kind = 'result' AND c.first IS NULL THEN 'orphan'
                WHEN e.kind = 'call' AND e.turn > c.first THEN 'duplicate'
                WHEN e.kind = 'call' AND e.text IS NULL THEN 'bad arguments'
                WHEN e.kind = 'call' AND r.call_id IS NULL THEN 'open' END AS problem,
           CASE e.kind
               WHEN 'call' THEN '{"role":"assistant","tool_calls":[{"arguments":{"prompt":'
                    || coalesce(to_json(e.text)::VARCHAR, 'null') || ',"turn":' || e.turn || '},"id":'
                    || to_json(e.call_id)::VARCHAR || ',"name":"reply"}]}'
               WHEN 'result' THEN '{"content":' || coalesce(to_json(e.text)::VARCHAR, 'null')
                    || ',"role":"tool","tool_call_id":' || to_json(e.call_id)::VARCHAR || '}'
               ELSE '{"content":' || coalesce(to_json(e.text)::VARCHAR, 'null') || ',"role":'
                    || to_json(e.role)::VARCHAR || '}' END AS json
    FROM e LEFT JOIN calls c ON e.conv_id = c.conv_id AND e.call_id = c.call_id AND e.kind != 'message'
           LEFT JOIN results r ON e.conv_id = r.conv_id AND e.call_id = r.call_id AND e.kind = 'call'"""

#: CRC-32 of a string, bit by bit.
_CRC32 = """xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, strlen({x}) + 1), lambda i: ascii({x}[i])::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                          lambda r, z: xor(r >> 1, 3988292384::BIGINT * (r & 1)))))"""


def _leaf_sql(text: str) -> str:
    fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


#: Ternary hash trees level by level, then every leaf climbs to the root with its siblings.
_MERKLE = f"""
    WITH RECURSIVE hashed AS (
        SELECT doc_id, source, {_leaf_sql("text")} AS leaf, {_leaf_sql("claimed")} AS claim
        FROM (SELECT *, CASE WHEN {_CRC32.format(x="(doc_id::VARCHAR)")} % 2 = 0
                             THEN replace(text, chr(10), '') ELSE text END AS claimed FROM documents)),
    leaves AS (
        SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER s AS n,
               row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx
        FROM hashed WINDOW s AS (PARTITION BY source)),
    nodes AS (
        SELECT tree, 0 AS lvl, idx, n, leaf AS h FROM leaves
        UNION ALL
        SELECT tree, lvl + 1, idx // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY idx))
        FROM nodes WHERE n > 1 GROUP BY tree, lvl, idx // 3),
    subroots AS (SELECT tree, h AS subroot, lvl AS top, count(*) OVER () AS n FROM nodes WHERE n = 1),
    upper AS (
        SELECT 0 AS lvl, tree AS idx, n, subroot AS h FROM subroots
        UNION ALL
        SELECT lvl + 1, idx // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY idx))
        FROM upper WHERE n > 1 GROUP BY lvl, idx // 3),
    -- a level's number continues over the sources: the tree of subroots starts above the tallest tree
    every AS (
        SELECT tree, lvl, idx, h FROM nodes WHERE n > 1
        UNION ALL
        SELECT -1, lvl + 1000, idx, h FROM upper WHERE n > 1),
    sides AS (
        SELECT a.tree, a.lvl, a.idx,
               coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx), '') AS lft,
               coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx), '') AS rgt
        FROM every a JOIN every b ON a.tree = b.tree AND a.lvl = b.lvl AND a.idx // 3 = b.idx // 3
        GROUP BY ALL),
    climb AS (
        SELECT l.tree AS own, l.idx AS leaf_idx, CASE WHEN top = 0 THEN -1 ELSE l.tree END AS tree,
               CASE WHEN top = 0 THEN 1000 ELSE 0 END AS lvl, CASE WHEN top = 0 THEN l.tree ELSE l.idx END AS idx,
               top, claim AS folded, '' AS proof
        FROM leaves l JOIN subroots r ON l.tree = r.tree
        UNION ALL
        SELECT own, leaf_idx, CASE WHEN c.lvl + 1 = top THEN -1 ELSE c.tree END,
               CASE WHEN c.lvl + 1 = top THEN 1000 ELSE c.lvl + 1 END,
               CASE WHEN c.lvl + 1 = top THEN own ELSE c.idx // 3 END, top,
               sha256(lft || folded || rgt), proof || lft || rgt
        FROM climb c JOIN sides s ON c.tree = s.tree AND c.lvl = s.lvl AND c.idx = s.idx),
    ended AS (SELECT own, leaf_idx, arg_max(folded, lvl) AS folded, arg_max(proof, lvl) AS proof
              FROM climb GROUP BY own, leaf_idx)
    SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
           folded = h AS verified
    FROM leaves l JOIN subroots r ON l.tree = r.tree JOIN ended e ON e.own = l.tree AND e.leaf_idx = l.idx
         CROSS JOIN (SELECT h FROM upper WHERE n = 1)"""

ORACLES = {
    "op3_chat": _CHAT,
    "op4_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM (SELECT doc_id, {_ASCII_LOWER} AS norm FROM documents)
        WINDOW w AS (PARTITION BY norm)""",
    "op11_merkle": _MERKLE,
}
