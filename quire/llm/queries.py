"""The opN queries: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fim, html_wrappers, langid, line_dedup, minhash, packing, pieces, quality, secrets, sharding, token_codec, trie
from .common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of documents; digest columns over the base kinds, spans over all kinds."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(F.encode(joined(F.filter("spans", lambda x: x["kind"].isin("assign", "access", "hex"))), "UTF-8"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by its host's wrapper."""
    found = html_wrappers.main_texts(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without its later repeated runs of lines."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the labelled documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 2,048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose two-word shingle sets have similarity 0.8 or more."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 of near-equal size."""
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document's ids, read back from the Huffman-coded files."""
    return token_codec.round_trip(table(spark, sf_dir, "documents"))


def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it contains."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, lengths and digests of every document cut for filling in its middle, and of the text rebuilt from that."""
    made = fim.transform(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    ids = pieces.encode(table(spark, sf_dir, "documents"))
    return pieces.decode(ids, keep=("n_tokens", "ids")).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations."""
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_html_extraction, op3_line_dedup, op4_language_id, op5_best_fit_packing, op6_minhash_near_duplicates, op7_sharding, op8_token_files, op9_benchmark_leaks, op10_quality_rules, op11_fill_in_middle, op12_sentence_pieces, op13_conversation_trie)}
#: All pairs of texts by an inverted index of whole shingle sets, and reachability; none of the bands or bounds.
OP6_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]] ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
 n AS (SELECT doc_id, len(sh) AS n FROM s), x AS (SELECT doc_id, unnest(sh) AS t FROM s),
 shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
 link AS (SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 80 * (p.n + q.n - i)),
 edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
 reach(v, u) AS (SELECT doc_id, doc_id FROM n UNION SELECT v, b FROM reach JOIN edge ON u = a)
 SELECT doc_id, n AS n_shingles, min(u) AS component_id, doc_id = min(u) AS kept FROM n JOIN reach ON v = doc_id GROUP BY doc_id, n"""

#: Tokens by the regular expression, one by one.
OP11_SQL = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS ts, sha256(concat('1:', doc_id)) AS h FROM documents),
 r AS (SELECT *, len(ts) AS n, list_transform([0, 1, 2, 3], lambda k: CAST('0x' || substr(h, CAST(8 * k + 1 AS INT), 8) AS BIGINT)) AS hs FROM t),
 c AS (SELECT *, least(hs[1] % (n + 1), hs[2] % (n + 1)) AS a, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR hs[3] % 100 >= 90 THEN 'plain' WHEN hs[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
 p AS (SELECT *, array_to_string(ts[1:a], '') AS pre, array_to_string(ts[a + 1:b], '') AS mid, array_to_string(ts[b + 1:], '') AS suf FROM c)
 SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""
#: Nodes as lists of turns; every node's share goes to all of its ancestors by its least member's prefixes.
OP13_SQL = r"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k, sha256(concat(length(coalesce(role, '')), ':', role, text)) AS x, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
 h AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce([CAST(4294967295 AS UBIGINT)] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS UBIGINT)),
   lambda crc, byte: list_reduce([xor(crc, byte)] || list_transform(range(8), lambda i: CAST(i AS UBIGINT)), lambda v, i: xor(v >> 1, (v & 1) * 3988292384))), 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
 u AS (SELECT h.conv_id, 0 AS own, k, x, chars FROM h JOIN t ON t.conv_id = h.base AND k <= h.h UNION ALL SELECT t.conv_id, 1, k, x, chars FROM h JOIN t ON t.conv_id = h.conv_id AND k > h.h),
 m AS (SELECT conv_id, list({'x': x, 'c': chars} ORDER BY own, k) FILTER (x IS NOT NULL) AS ts FROM (SELECT conv_id, own, k, x, chars FROM u UNION ALL SELECT conv_id, NULL, NULL, NULL, NULL FROM h) GROUP BY conv_id),
 d AS (SELECT conv_id, coalesce(ts, []) AS ts, unnest(range(len(coalesce(ts, [])) + 1)) AS depth FROM m),
 v AS (SELECT conv_id, depth, sha256(array_to_string(list_transform(ts[:depth], lambda y: y.x), ',')) AS node, sha256(array_to_string(list_transform(ts[:depth - 1], lambda y: y.x), ',')) AS up, coalesce(ts[depth].c, 0) AS chars, len(ts) = depth AS last FROM d),
 g AS (SELECT depth, node, any_value(CASE WHEN depth > 0 THEN up END) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '') AS ends FROM v GROUP BY depth, node),
 k AS (SELECT depth - 1 AS depth, up AS node, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY ALL),
 e AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN k USING (depth, node)),
 f AS (SELECT v.depth, v.node, sum((e.n_convs - 1) * e.chars) AS saved_tokens, count(*) FILTER (e.n_children = 0) AS n_leaves FROM e JOIN v ON v.conv_id = e.conv_id AND v.depth <= e.depth GROUP BY ALL)
 SELECT e.conv_id, e.depth, p.conv_id AS parent_conv_id, e.n_convs, e.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(e.ends) AS ends_sha256
 FROM e JOIN f USING (depth, node) LEFT JOIN g p ON p.depth = e.depth - 1 AND p.node = e.up"""

ORACLE_SQL: dict[str, str] = {"op6_minhash_near_duplicates": OP6_SQL, "op11_fill_in_middle": OP11_SQL, "op13_conversation_trie": OP13_SQL}
