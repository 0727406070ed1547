"""One query per operator, with comparison SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.llm import (bayes_jaccard, cgk_decontam, crf_pii, decision_list, hash_shards, html_consensus, parse_phrases, repair_tokens,
                            shared_viterbi, spectrum_whitening, substring_dedup, tier_packing, url_rules)
from panelspark.llm.common import read
from panelspark.operators.keys import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# ---- op1: personal data

@query
def op1_crf_pii(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    field = crf_pii.train(crf_pii.training_runs(docs, "doc_id", "text"))
    return crf_pii.pii_spans(docs, field)


# ---- op2: n-gram Jaccard join

@query
def op2_bayes_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return bayes_jaccard.jaccard_classes(read(spark, sf, "documents"))


# ---- op3: substring dedup

@query
def op3_count_min_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.substring_dedup(read(spark, sf, "documents"))


SQL["op3_count_min_dedup"] = """
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
     s AS (SELECT doc_id, i, array_to_string(w[i:i+34], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
     r AS (SELECT win FROM s GROUP BY win HAVING count(*) > 1),
     g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM s JOIN r USING (win)),
     k AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) FILTER (NOT hit) AS kept, count(*) FILTER (hit) AS n_removed
           FROM (SELECT e.*, g.i IS NOT NULL AS hit
                 FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) e LEFT JOIN g USING (doc_id, i)) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""


# ---- op4: token ids in binary shards

@query
def op4_repair_tokens(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    repair_tokens.write_tokens(read(spark, sf, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return repair_tokens.read_tokens(spark, path)


# ---- op5: quality rules

@query
def op5_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    rules = decision_list.learn(decision_list.labelled(docs, read(spark, sf, "labels")))
    s = decision_list.quality_rules(docs.select("doc_id", "text"), rules)
    return s.select("doc.doc_id", "_s.w.n_words", "_s.word_chars", "_s.n_symbols", F.col("_s.lines.dup").alias("n_dup_lines"),
                    "_s.w.n_repeat_words", F.col("_base").alias("base_failed"), F.col("_kept").alias("kept"),
                    F.col("_rule").alias("rule"))


# ---- op6: HTML extraction

@query
def op6_html_consensus(spark: SparkSession, sf: str) -> DataFrame:
    return html_consensus.main_text(read(spark, sf, "pages"))


# ---- op7: URL filters

HOST_RULES = [url_rules.HostRule("block", "net", "/"), url_rules.HostRule("allow", "example.net", "/en/"),
              url_rules.HostRule("block", "example.com", "/de/"), url_rules.HostRule("allow", "org", "/fr/")]
PATTERN_RULES = [
    url_rules.PatternRule("block", r"(^|[./-])cheap-pills([./-]|$)", ("cheap", "pills")),
    url_rules.PatternRule("block", r"(^|[./-])spam-farm([./-]|$)", ("spam", "farm")),
    url_rules.PatternRule("block", r"(^|[./-])casino([./-]|$)", ("casino",)),
    url_rules.PatternRule("block", r"(^|[./-])free-download([./-]|$)", ("free", "download")),
    url_rules.PatternRule("block", r"[./-]xxx([./-]|$)", ("xxx",)),
]


@query
def op7_url_rules(spark: SparkSession, sf: str) -> DataFrame:
    return url_rules.filter_urls(read(spark, sf, "pages"), HOST_RULES + PATTERN_RULES)


def _pattern_sql() -> str:
    out = "NULL"
    for r in sorted(PATTERN_RULES, key=lambda r: (len(r.name), r.name)):
        out = f"CASE WHEN regexp_matches(lower(u), '{r.regex}') THEN '{r.regex}' ELSE {out} END"
    return out


SQL["op7_url_rules"] = rf"""
WITH a AS (SELECT page_id, coalesce(url, '') AS u,
                  lower(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1)) AS host,
                  regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
     b AS (SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                          WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                          WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                          WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
                  {_pattern_sql()} AS pattern FROM a)
SELECT page_id, host, path, rule, pattern,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM b"""


# ---- op8: benchmark decontamination

@query
def op8_cgk_decontam(spark: SparkSession, sf: str) -> DataFrame:
    return cgk_decontam.contaminated(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


# ---- op9: SentencePiece encoding and decoding

@query
def op9_shared_viterbi(spark: SparkSession, sf: str) -> DataFrame:
    return shared_viterbi.encode_decode(read(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


# ---- op10: sharding; a small limit, so that the test tables have many shards

SHARD_BYTES = 1 << 20


@query
def op10_hash_shards(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", F.octet_length("text").alias("n_bytes"))
    placed = hash_shards.assign_shards(docs, "doc_id", F.col("n_bytes"), SHARD_BYTES)
    shards = hash_shards.directory(placed, SHARD_BYTES)
    return (placed.join(shards, "_shard")
            .select("doc.doc_id", F.col("_shard").alias("shard"), "depth", F.col("_bytes").alias("n_bytes"),
                    "shard_rows", "shard_bytes", "over"))


SQL["op10_hash_shards"] = f"""
WITH d AS (SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes,
                  right(CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS BIT)::VARCHAR, 60) AS bits
           FROM documents),
     e AS (SELECT d.*, depth, substr(bits, 1, depth::INT) AS shard FROM d, range(0, 24) AS r(depth)),
     f AS (SELECT shard, depth, count(*) AS shard_rows, sum(n_bytes) AS shard_bytes FROM e GROUP BY ALL),
     g AS (SELECT doc_id, min(depth) AS depth FROM e JOIN f USING (shard, depth)
           WHERE shard_bytes <= {SHARD_BYTES} OR shard_rows = 1 GROUP BY ALL)
SELECT doc_id, shard, depth, n_bytes, shard_rows, CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_bytes > {SHARD_BYTES} AS over
FROM g JOIN e USING (doc_id, depth) JOIN f USING (shard, depth)"""


# ---- op11: phrase collocation mining

@query
def op11_parse_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return parse_phrases.collocations(read(spark, sf, "documents"))


SQL["op11_parse_phrases"] = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
                  string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
     p AS (SELECT lang, regexp_extract_all(unnest(ps), '[^\x20\x09]+') AS w FROM d),
     g AS (SELECT lang, 1 AS k, unnest(w) AS phrase FROM p
           UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM p
           UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM p),
     f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
     n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
     c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
     cut AS (SELECT c.lang, c.phrase, c.a, c.w, c.k, x.a AS l, y.a AS r, x.k AS cut_at,
                    CAST(CAST(1000000 AS HUGEINT) * c.a * c.a // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
             FROM (SELECT *, unnest(range(1, k)) AS i FROM c) c
             JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:i], ' ') AND x.k = c.i
             JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[i + 1:], ' ') AND y.k = c.k - c.i),
     s AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut_at) = 1),
     longer AS (SELECT lang, part, max(a) AS a FROM
                (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM c WHERE k = 3) GROUP BY ALL),
     t AS (SELECT s.* FROM s LEFT JOIN longer ON longer.lang = s.lang AND longer.part = s.phrase WHERE longer.a IS NULL OR 100 * longer.a < 50 * s.a)
SELECT t.lang, CAST(row_number() OVER (PARTITION BY t.lang ORDER BY score DESC, a DESC, encode(phrase)) AS BIGINT) AS rank, phrase, a, l, r, n, score
FROM t JOIN n ON n.lang = t.lang QUALIFY rank <= 2000"""


# ---- op12: packing

@query
def op12_tier_packing(spark: SparkSession, sf: str) -> DataFrame:
    return tier_packing.pack_texts(read(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


# ---- op13: embedding whitening

@query
def op13_spectrum_whitening(spark: SparkSession, sf: str) -> DataFrame:
    w = spectrum_whitening.whiten(read(spark, sf, "embeddings"))
    return w.withColumn("deviation", F.col("deviation").cast("long"))
