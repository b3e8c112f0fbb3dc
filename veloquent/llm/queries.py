"""Registered queries of the thirteen operators: each applies its operator to its whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import decode, encode
from .embed_dedup import near_duplicates
from .fill_middle import fill_in_middle, restore
from .html_extract import extract_text
from .license_scan import BASE_PHRASES, scan_licenses
from .mixing import TARGETS, mix
from .ngram_lm import score_texts
from .packing import pack_documents
from .quality_rules import BASE, quality_stats
from .rule_ensemble import THRESHOLD, bucket, fit_quality, score_quality
from .simhash import hex_bits, simhash_components
from .url_filter import RULES, judge_urls
from .vector_codes import compress


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all documents and their near-duplicate components."""
    found = simhash_components(_read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), hex_bits().alias("fingerprint"), F.col("component").alias("component_id"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract_text(_read(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and the robust outlier verdict of all documents."""
    found = quality_stats(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", *BASE, "base_failed", "kept", "d2")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and signatures in all documents."""
    found = scan_licenses(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain posteriors and mixing rates of all documents."""
    found = mix(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), ["doc_id"])
    return found.select("doc_id", "tokens", *(F.get("p", F.lit(k)).alias(f"p_{name}") for k, name in enumerate(TARGETS)), "rate", "copies")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all page URLs."""
    return judge_urls(_read(spark, sf_dir, "pages"))


def op7_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate links and components of all embeddings."""
    return near_duplicates(_read(spark, sf_dir, "embeddings")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token sequences of at most 1024 ids."""
    return pack_documents(_read(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base scores and trie scores of all documents."""
    return score_texts(_read(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from labels outside the held-out quarter."""
    docs = _read(spark, sf_dir, "documents")
    model = fit_quality(docs, _read(spark, sf_dir, "labels"), bucket("doc_id", 4) != 2)
    scored = score_quality(docs, model)
    return scored.select("doc_id", (bucket("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of all documents and the bytes decoded from them, as digests."""
    coded = decode(encode(_read(spark, sf_dir, "documents")))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product-quantiser codes of all embeddings."""
    return compress(_read(spark, sf_dir, "embeddings"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents rearranged for filling in the middle and rebuilt, as digests."""
    done = restore(fill_in_middle(_read(spark, sf_dir, "documents")))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def base_quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of op3 that SQL can tell."""
    return op3_quality_rules(spark, sf_dir).select("doc_id", *BASE, "base_failed")


def base_license_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of op4's base phrases."""
    return op4_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def base_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts, paths and rules of op6, with the verdicts that the rules give."""
    return op6_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLACES = " || ".join(f"list_transform(list_filter(range(1, len(w) - {len(p.split()) - 2}), lambda i: array_to_string(w[i:i + {len(p.split()) - 1}], ' ') = '{p}'), lambda i: {{'at': i - 1, 'l': '{label}'}})" for p, label in BASE_PHRASES.items())
_FITS = " ".join(f"WHEN (host = '{r.split('/')[0]}' OR ends_with(host, '.{r.split('/')[0]}')) AND starts_with(path, '{r[r.index('/'):]}') THEN '{r}'" for r in sorted(RULES, key=len, reverse=True))
_DRAW = "CAST('0x' || substr(h, {}, 8) AS BIGINT)"
_SQUARES = " + ".join(f"(x.{c} - b.{c}) * (x.{c} - b.{c})" for c in "abcd")


def _round(k: int) -> str:
    """Assignment to the codebooks of round ``k`` and, before the last, the codebooks that follow; floors go down."""
    near = f"n{k} AS MATERIALIZED (SELECT x.vec_id, x.p, min(64 * ({_SQUARES}) + b.e) AS m, any_value(x.a) AS a, any_value(x.b) AS b, any_value(x.c) AS c, any_value(x.d) AS d FROM x JOIN b{k} b USING (p) GROUP BY x.vec_id, x.p)"
    if k == 2:
        return near
    floors = ", ".join(f"coalesce((s.{c} - ((s.{c} % s.n) + s.n) % s.n) // s.n, b.{c}) AS {c}" for c in "abcd")
    return near + f""",
    b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, {floors} FROM b{k} b LEFT JOIN (SELECT p, m % 64 AS e, CAST(count(*) AS BIGINT) AS n, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in 'abcd')} FROM n{k} GROUP BY ALL) s ON s.p = b.p AND s.e = b.e)"""


SQL = {
    "op12_vector_codes": f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    x AS MATERIALIZED (SELECT vec_id, p, v[4 * p + 1] AS a, v[4 * p + 2] AS b, v[4 * p + 3] AS c, v[4 * p + 4] AS d FROM k, range(16) r(p)),
    b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, a, b, c, d FROM x QUALIFY e < 64),
    {_round(0)},
    {_round(1)},
    {_round(2)},
    c AS (SELECT vec_id, string_agg(format('{{:02x}}', m % 64), '' ORDER BY p) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM n2 GROUP BY vec_id)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(concat_ws(',', a, b, c, d), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256 FROM c JOIN k USING (vec_id)""",
    "op13_fill_middle": f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    c AS (SELECT *, len(u) AS n, least({_DRAW.format(1)} % (len(u) + 1), {_DRAW.format(9)} % (len(u) + 1)) AS a, greatest({_DRAW.format(1)} % (len(u) + 1), {_DRAW.format(9)} % (len(u) + 1)) AS z,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_DRAW.format(17)} % 100 >= 90 THEN 'plain' WHEN {_DRAW.format(25)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
    p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:z], '') AS mid, array_to_string(u[z + 1:], '') AS suf FROM c)
    SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
    "base_quality_statistics": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
    g AS (SELECT doc_id, i, hash(w[i:i + 7]) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
    c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, h) AS m FROM g), range(8) r(k) WHERE m > 1 GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
      coalesce(n, 0) AS n_repeat_words, len(w) < 20 OR 100 * coalesce(n, 0) > 30 * len(w) AS base_failed FROM d LEFT JOIN c USING (doc_id)""",
    "base_license_places": f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents), p AS (SELECT doc_id, len(w) AS n, {_PLACES} AS p FROM d)
    SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base, list_min(list_transform(p, lambda x: x.at)) AS first_word, list_max(list_transform(p, lambda x: x.at)) AS last_word, array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.l))), ',') AS base_labels FROM p""",
    "base_url_rules": f"""WITH r AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages), h AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
    f AS (SELECT *, CASE {_FITS} END AS rule FROM h) SELECT page_id, host, path, rule, CASE rule {' '.join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES.items())} END AS verdict FROM f""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_simhash, op2_html_extract, op3_quality_rules, op4_license_scan, op5_mixing, op6_url_filter, op7_embed_dedup, op8_best_fit_packing, op9_lm_scoring, op10_quality_classifier, op11_byte_bpe, op12_vector_codes, op13_fill_middle, base_quality_statistics, base_license_places, base_url_rules)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """SQL for vector codes, fill-in-the-middle and the base columns; fitted models, link closures, searches, XXH64, CRC-32 and tokenizers are beyond it."""
    return SQL
