"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, divergence, mixing, packing, pii, quality, sharding, simhash, substring, toxicity, trie, warc
from .common import table


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shard_1", "shard_2")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality.ledger(table(spark, sf_dir, "documents"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return led.select("doc_id", *base, quality.fails("base").alias("base_failed"), (~quality.fails()).alias("kept"), "failed")


def ranks_path() -> str:
    """The installed rank file of the vocabulary that byte_bpe_50k.json holds."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), ranks_path())


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents")).select("lang", "source", "part", "item", "value", "rank")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"), shared=True)


def op13_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_simhash_dedup, op2_toxicity, op3_substring_dedup, op4_mixing, op5_ann, op6_quality_rules, op7_best_fit_packing, op8_sharding, op9_chat_formatting, op10_pii, op11_source_divergence, op12_prefix_trie, op13_warc_archives]
    return {f.__name__: f for f in found}


_WORDS = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 t AS (SELECT r, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM d)"""

OP3 = rf"""{_WORDS}, g AS (SELECT r, p, string_agg(t, ' ') OVER w AS gram, count(*) OVER w AS n FROM t WINDOW w AS (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND {substring.WINDOW - 1} FOLLOWING)),
 s AS (SELECT r, p, count(*) OVER (PARTITION BY gram) AS times FROM g WHERE n = {substring.WINDOW}),
 c AS (SELECT DISTINCT r, p + k AS p FROM s, range(0, {substring.WINDOW}) x(k) WHERE times > 1),
 gone AS (SELECT r, count(*) AS n FROM c GROUP BY r), kept AS (SELECT r, string_agg(t, ' ' ORDER BY p) AS text FROM t ANTI JOIN c USING (r, p) GROUP BY r)
 SELECT doc_id, len(w) AS n_words, coalesce(gone.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)"""

OP6 = rf"""{_WORDS}, g AS (SELECT r, p, string_agg(t, ' ') OVER w AS gram, count(*) OVER w AS n FROM t WINDOW w AS (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
 s AS (SELECT r, p, count(*) OVER (PARTITION BY r, gram) AS times FROM g WHERE n = 8),
 c AS (SELECT r, count(DISTINCT p + k) AS n FROM s, range(0, 8) x(k) WHERE times > 1 GROUP BY r),
 l AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
 m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.dup, 0) AS n_dup_lines,
  coalesce(c.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS n_lines, length(regexp_replace(text, '[^A-ZÀ-ÖØ-ÞΑ-ΩА-Я]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^\pL]', '', 'g')) AS n_letters FROM d LEFT JOIN l USING (r) LEFT JOIN c USING (r)),
 f AS (SELECT *, CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END + CASE WHEN 100 * n_symbols > 5 * word_chars THEN 4 ELSE 0 END + CASE WHEN n_letters >= 40 AND 100 * n_upper > 60 * n_letters THEN 8 ELSE 0 END
  + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 16 ELSE 0 END + CASE WHEN word_chars > 25 * n_words THEN 32 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 64 ELSE 0 END AS bits FROM m)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bits & 3 <> 0 AS base_failed, bits & 127 = 0 AS kept, CAST(bits AS BIGINT) AS failed FROM f"""

OP11 = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
 t AS (SELECT r, lang, source, unnest(w) AS term FROM d), g AS (SELECT DISTINCT lang, source FROM d),
 kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10), l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
 n AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL), c AS (SELECT lang, source, term, coalesce(n.n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN n USING (lang, source, term)),
 p AS (SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM c JOIN l USING (lang)),
 q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 2) // (total + 2 * v) AS q FROM kept JOIN l USING (lang)),
 s AS (SELECT lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
 pair AS (SELECT lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b USING (lang) LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source WHERE a.source <> b.source),
 term AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
 x AS (SELECT *, 'pair' AS part FROM pair UNION ALL SELECT *, 'term' FROM term)
 SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM x QUALIFY part = 'pair' OR rank <= 10"""

#: CRC-32 bit by bit, over the digits.
OP12 = """WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x FROM conversations WHERE conv_id IS NOT NULL),
 o AS (SELECT c, list(x ORDER BY p) AS own FROM t GROUP BY c),
 h AS (SELECT c, own, xor(list_reduce([4294967295::BIGINT] || [ascii(k)::BIGINT FOR k IN string_split(c::VARCHAR, '')], lambda a, b: list_reduce([xor(a, b)] || range(8), lambda s, i: xor(s >> 1, 3988292384 * (s & 1)))), 4294967295) % 9 AS h FROM o),
 s AS (SELECT h.c, coalesce(b.own[1:h.h], []) || h.own[h.h + 1:] AS seq FROM h LEFT JOIN o b ON b.c = h.c - h.c % 5),
 m AS (SELECT c, len(seq) AS n, d, seq[1:d] AS k FROM s, range(0, (SELECT max(len(seq)) + 1 FROM s)) r(d) WHERE d <= len(seq)),
 n AS (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, CASE WHEN d > 0 THEN (count(*) - 1) * strlen(any_value(k[-1].t)) ELSE 0 END AS saved, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256 FROM m GROUP BY d, k),
 u AS (SELECT n.d, n.k, n.conv_id, n.n_convs, n.saved, n.ends_sha256, count(b.d) AS n_children FROM n LEFT JOIN n b ON b.d = n.d + 1 AND b.k[1:n.d] = n.k GROUP BY ALL),
 w AS (SELECT a.d, a.k, count(*) FILTER (b.n_children = 0) AS n_leaves, sum(b.saved)::BIGINT AS saved_tokens FROM u a JOIN u b ON b.d >= a.d AND b.k[1:a.d] = a.k GROUP BY a.d, a.k)
 SELECT u.conv_id, u.d AS depth, p.conv_id AS parent_conv_id, u.n_convs, u.n_children, w.n_leaves, w.saved_tokens, u.ends_sha256 FROM u JOIN w USING (d, k) LEFT JOIN n p ON p.d = u.d - 1 AND p.k = u.k[1:u.d - 1]"""

#: Base 32 from five hexadecimal digits at a time.
OP13 = """WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS raw FROM pages), h AS (SELECT *, sha1(raw) AS h FROM p),
 n AS (SELECT *, row_number() OVER w AS n, first_value(page_id) OVER w AS top FROM h WINDOW w AS (PARTITION BY raw ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST))
 SELECT page_id, octet_length(raw) AS payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::INT >> (15 - 5 * (i % 4))) & 31), 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN n > 1 THEN top END AS refers_to FROM n"""


def oracle_sql() -> dict[str, str]:
    """Of the queries that SQL can express: passages, rules, counts, tries and digests. XXH64, models and tokens are beyond it."""
    return {"op3_substring_dedup": OP3, "op6_quality_rules": OP6, "op11_source_divergence": OP11, "op12_prefix_trie": OP12, "op13_warc_archives": OP13}
