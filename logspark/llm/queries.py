"""The corpus queries: each operator over its whole table, with production settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.llm import (
    decontaminate, hard_negatives, language, licenses, packing, quantizer, repetition, secrets, simhash, suffixes, topk,
    toxicity, urls,
)
from logspark.llm.common import held_out, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


def byte_tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@register("op2_packing")
def op2_packing(spark, folder):
    pieces = packing.pack(read(spark, folder, "documents"), *byte_tokenizer())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
        "boundary", "sequence_tokens", "padded_to")


@register("op9_simhash")
def op9_simhash(spark, folder):
    found = simhash.near_duplicates(read(spark, folder, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


@register("op1_decontamination")
def op1_decontamination(spark, folder):
    return decontaminate.contained(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@register("op8_secrets")
def op8_secrets(spark, folder):
    found = secrets.secrets(read(spark, folder, "documents"))
    base = secrets.of_kinds(F.col("findings"), secrets.BASE)
    return found.select(
        "doc_id",
        *[secrets.count_kind(F.col("findings"), kind).alias(f"n_{kind}") for kind in secrets.BASE],
        F.sha2(secrets.span_text(base), 256).alias("base_sha256"),
        secrets.span_text(F.col("findings")).alias("spans"))


@register("op5_toxicity")
def op5_toxicity(spark, folder):
    docs = read(spark, folder, "documents")
    model = toxicity.fit(docs, read(spark, folder, "labels"))
    return toxicity.scored(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@register("op7_language")
def op7_language(spark, folder):
    docs = read(spark, folder, "documents")
    found = language.identified(docs, language.fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages", "shares")


@register("op6_url_filter")
def op6_url_filter(spark, folder):
    return urls.judged(read(spark, folder, "pages"))


@register("op10_topk")
def op10_topk(spark, folder):
    rows = topk.prepared(read(spark, folder, "embeddings"))
    return topk.search(rows, rows.where("vec_id % 50 = 0"))


@register("op3_suffix_dedup")
def op3_suffix_dedup(spark, folder):
    return suffixes.passages(read(spark, folder, "documents"))


@register("op4_license_scan")
def op4_license_scan(spark, folder):
    return licenses.licences(read(spark, folder, "documents"))


def _whole(scale: int) -> str:
    """Vectors that take part, as whole numbers."""
    return (f"list_transform(embedding, lambda x: floor({scale} * x::double)) AS v FROM embeddings WHERE embedding IS NOT NULL "
            "AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0")


def _quantizer_sql() -> str:
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, {_whole(1024)})",
        "cut AS MATERIALIZED (SELECT r, vec_id, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS x FROM kept, range(4) t(p))",
        "b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM cut WHERE vec_id IN (SELECT vec_id "
        "FROM kept WHERE vec_id IS NOT NULL ORDER BY vec_id LIMIT 256))"]
    for n in range(5):
        steps.append(
            f"a{n} AS MATERIALIZED (SELECT r, p, any_value(x) AS x, arg_min(e, d * 256 + e) AS e, min(d) AS d FROM (SELECT c.r, c.p, "
            "c.x, b.e, list_inner_product(c.x, c.x) - 2 * list_inner_product(c.x, b.x) + list_inner_product(b.x, b.x) AS d "
            f"FROM cut c JOIN b{n} b ON b.p = c.p) m GROUP BY r, p)")
        steps.append(
            f"b{n + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(u.x, b.x) AS x FROM b{n} b LEFT JOIN (SELECT p, e, list(floor(s / n) "
            "ORDER BY i) AS x FROM (SELECT p, e, i, sum(c) AS s, count(*) AS n FROM (SELECT p, e, unnest(x) AS c, "
            f"generate_subscripts(x, 1) AS i FROM a{n}) q GROUP BY p, e, i) g GROUP BY p, e) u ON u.p = b.p AND u.e = b.e)")
    return (
        f"WITH {', '.join(steps)} SELECT k.vec_id, code, error, cast(sum(error) OVER (PARTITION BY label) AS bigint) AS label_error, "
        "(SELECT sha256(string_agg(cast(cast(c AS bigint) AS string), ',' ORDER BY p, e, i)) FROM (SELECT p, e, unnest(x) AS c, "
        "generate_subscripts(x, 1) AS i FROM b4) f) AS codebooks_sha256 FROM kept k JOIN (SELECT r, string_agg(lower(printf('%02x', e)), '' "
        "ORDER BY p) AS code, cast(sum(d) AS bigint) AS error FROM a4 GROUP BY r) z ON z.r = k.r")


@register("op11_vector_codes", _quantizer_sql())
def op11_vector_codes(spark, folder):
    return quantizer.compressed(read(spark, folder, "embeddings")).select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256")


@register("op12_hard_negatives", f"""WITH kept AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l,
 {_whole(256)} AND label IS NOT NULL AND vec_id IS NOT NULL),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, a.l = b.l AS same, cast(list_inner_product(a.v, b.v) AS bigint) AS s FROM kept a
 JOIN kept b ON b.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0),
best AS (SELECT a, b, s FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM pairs WHERE same) q WHERE k <= 5)
SELECT anchor_id, positive_id, cast(k AS int) AS rank, negative_id, positive_score, negative_score FROM (SELECT g.a AS anchor_id,
 g.b AS positive_id, n.b AS negative_id, g.s AS positive_score, n.s AS negative_score, row_number() OVER (PARTITION BY g.a, g.b
 ORDER BY n.s DESC, n.b) AS k FROM best g JOIN pairs n ON n.a = g.a AND NOT n.same AND 50 * g.s <= 100 * n.s
 AND 100 * n.s <= 95 * g.s) q WHERE k <= 3""")
def op12_hard_negatives(spark, folder):
    table = read(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.prepared(table.withColumn("label", label))
    return hard_negatives.mined(rows, rows.where("vec_id % 50 = 0"))


_WORD = "[^\\x20\\x09-\\x0D]+"
_FAILED = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"


def _windows(name: str, size: int) -> str:
    """Words inside windows of ``size`` words that a text has twice or more."""
    text = " || ' ' || ".join("word" if n == 0 else f"lead(word, {n}) OVER o" for n in range(size))
    return (
        f"{name} AS (SELECT r, count(*) AS n FROM (SELECT r, max(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {size - 1} PRECEDING AND "
        "CURRENT ROW) AS inside FROM (SELECT r, i, CASE WHEN run IS NOT NULL AND count(*) OVER (PARTITION BY r, run) > 1 THEN 1 ELSE 0 END "
        f"AS again FROM (SELECT r, i, {text} AS run FROM t WINDOW o AS (PARTITION BY r ORDER BY i)) x) y) z WHERE inside = 1 GROUP BY r)")


@register("op13_quality", f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT r, regexp_extract_all(text, '{_WORD}') AS words FROM d),
t AS MATERIALIZED (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
{_windows("three", 3)}, {_windows("five", 5)},
far AS (SELECT DISTINCT r FROM (SELECT r, md5(array_to_string(words[i:i + 100], ' ')) AS run FROM (SELECT r, words, unnest(range(1,
 len(words) - 99)) AS i FROM w WHERE len(words) > 100) x) y GROUP BY r, run HAVING count(*) > 1),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) l
 WHERE regexp_matches(line, '{_WORD}') GROUP BY r),
counts AS (SELECT d.r, doc_id, len(words) AS n_words, length(regexp_replace(text, '{_WORD[0] + _WORD[2:-1]}', '', 'g')) AS word_chars,
 length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(three.n, 0) AS
 n_repeat_words, coalesce(five.n, 0) AS covered, far.r IS NOT NULL AS long FROM d JOIN w ON w.r = d.r LEFT JOIN lines ON lines.r = d.r
 LEFT JOIN three ON three.r = d.r LEFT JOIN five ON five.r = d.r LEFT JOIN far ON far.r = d.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {_FAILED} AS base_failed,
 NOT ({_FAILED} OR 100 * covered > 30 * n_words OR long) AS kept, covered AS n_covered_words FROM counts""")
def op13_quality(spark, folder):
    found = repetition.judged(read(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                        F.col("covered").alias("n_covered_words"))
