"""One query per corpus operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafmark.llm.alignment import alignment_report
from leafmark.llm.bpe_trie import encode_and_decode
from leafmark.llm.common import table
from leafmark.llm.exact_dedup import exact_dedup
from leafmark.llm.jaccard import jaccard_join
from leafmark.llm.manifest import merkle_manifest
from leafmark.llm.packing import pack_documents, placements
from leafmark.llm.personal_data import find_personal_data
from leafmark.llm.quality import judge_quality
from leafmark.llm.secret_scan import secret_report
from leafmark.llm.sharding import shard_documents
from leafmark.llm.token_counts import token_counts
from leafmark.llm.warc import archive_pages
from leafmark.llm.toxicity import score_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_query("op1_jaccard_join", """
    WITH RECURSIVE w AS (
        SELECT doc_id, list_filter(string_split_regex(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
        FROM documents
    ), s AS (
        SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
            ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w
    ), e AS (SELECT doc_id, unnest(sh) AS g FROM s),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT x, y FROM p JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE 100 * c >= 90 * (len(a.sh) + len(b.sh) - c)),
    m AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
    r AS (SELECT doc_id, doc_id AS seen FROM s UNION SELECT r.doc_id, m.y FROM r JOIN m ON r.seen = m.x)
    SELECT doc_id, len(sh)::BIGINT AS n_shingles, least_id AS component_id
    FROM s JOIN (SELECT doc_id, min(seen) AS least_id FROM r GROUP BY doc_id) USING (doc_id)
""")
def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), width=3, percent=90).members.select("doc_id", "n_shingles", "component_id")


@_query("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placements(pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json")))


@_query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


@_query("op4_exact_dedup", """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
         g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
""")
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


@_query("op5_bpe")
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


@_query("op6_sharding")
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=40)


def _secret_sql() -> str:
    """The base patterns as they are stated; short matches are dropped afterwards."""
    kinds = [
        ("assign", r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
        ("access", "AKIA[A-Z0-9]+", 0, 16),
        ("hex", "[0-9a-f]{32,}", 0, 32),
    ]
    parts = [f"""
        SELECT doc_id, '{kind}' AS kind, {place} AS place, i,
               coalesce(list_sum(gaps[1:i]), 0) + coalesce(list_sum(runs[1:i - 1]), 0) AS s, runs[i] AS n, vals[i] AS v, {least} AS least
        FROM (SELECT *, unnest(range(1, len(runs) + 1)) AS i FROM (
            SELECT doc_id, list_transform(string_split_regex(t, '{pattern}'), lambda x: length(x)) AS gaps,
                   list_transform(regexp_extract_all(t, '{pattern}', 0), lambda x: length(x)) AS runs,
                   list_transform(regexp_extract_all(t, '{pattern}', {group}), lambda x: length(x)) AS vals
            FROM d WHERE regexp_matches(t, '{pattern}')))
    """ for place, (kind, pattern, group, least) in enumerate(kinds)]
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
         f AS (SELECT doc_id, kind, place, s::BIGINT AS s, (s + n)::BIGINT AS e FROM ({" UNION ALL ".join(parts)}) WHERE v >= least),
         g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
                      count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) AS spans
               FROM f GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN g ON d.doc_id IS NOT DISTINCT FROM g.doc_id
    """


@_query("op8_secret_scan", _secret_sql())
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


@_query("op7_personal_data")
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


@_query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query("op11_alignment")
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_report(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


@_query("op12_manifest")
def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(table(spark, sf_dir, "documents")).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _warc_sql() -> str:
    """SHA-1 in base 32 by hand: eight runs of five hex digits, four letters each."""
    letters = " || ".join(
        f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hx, {5 * i + 1}, 5))::BIGINT >> {15 - 5 * j}) & 31)::INT + 1, 1)"
        for i in range(8) for j in range(4))
    return f"""
    WITH d AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hx FROM pages),
         b AS (SELECT page_id, payload_bytes, {letters} AS payload_digest FROM d),
         g AS (SELECT payload_digest, payload_bytes, max(page_id) AS keep FROM b GROUP BY payload_digest, payload_bytes)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to
    FROM b JOIN g USING (payload_digest, payload_bytes)
    """


@_query("op13_warc", _warc_sql())
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
