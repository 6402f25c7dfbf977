"""The queries of the training-data operators: thin contract digests over the operators' own outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import held_out, read_table

#: The rules of op2 (fixed values): host, path, verdict.
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.quality_classifier import fit, score_quality

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read_table(spark, sf_dir, "labels"), "quality", ~held_out(F.col("id")))
    return score_quality(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.url_filter import filter_urls

    return filter_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.exact_dedup import with_groups

    return with_groups(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("row")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.chat_format import format_chats

    return format_chats(read_table(spark, sf_dir, "conversations"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.sentencepiece_codec import encode_documents

    return encode_documents(read_table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.suffix_dedup import without_repeats

    cut = without_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"), texts=False)
    return cut.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.simhash import with_components

    found = with_components(read_table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.packing import pack

    return pack(read_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.quality_rules import with_quality

    return with_quality(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.toxicity import fit, score_toxicity

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read_table(spark, sf_dir, "labels"), "toxic", ~held_out(F.col("id")))
    return score_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.hard_negatives import hard_negatives

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.decontamination import with_leaks, words_hit

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    leak = F.col("leak")
    found = with_leaks(docs, read_table(spark, sf_dir, "benchmark")).select("doc_id", leak["n_words"].alias("n_words"), words_hit(leak).alias("n_hit"), leak["items"].alias("items"))
    items = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.fill_in_middle import fill_in_middle, restored

    made = fill_in_middle(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_url_filter": op2_url_filter,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_chat_format": op4_chat_format,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_simhash": op7_simhash,
    "op8_packing": op8_packing,
    "op9_quality_rules": op9_quality_rules,
    "op10_toxicity": op10_toxicity,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_decontamination": op12_decontamination,
    "op13_fill_in_middle": op13_fill_in_middle,
    "pipeline": pipeline,
}

#: White space of the contracts as a RE2 class.
_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FITS = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}|{v}'" for h, p, v in sorted(URL_RULES, key=lambda r: -len(r[0] + r[1]))
)

SQL: dict[str, str] = {
    "op2_url_filter": rf"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, {_LOWER.format(x="regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, CASE {_FITS} END AS hit FROM b)
SELECT page_id, host, path, split_part(hit, '|', 1) AS rule, coalesce(split_part(hit, '|', 2), 'allow') AS verdict FROM c""",
    "op3_exact_dedup": rf"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '{_SPACE}+', '', 'g') AS k FROM documents),
r AS (SELECT doc_id, k, first_value(doc_id) OVER (PARTITION BY k ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY k) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(k) AS text_sha256 FROM r""",
    "op4_chat_format": """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) AS told FROM conversations),
p AS (SELECT conv_id, n, string_agg(told, '') OVER (PARTITION BY conv_id ORDER BY n) AS prefix, max(n) OVER (PARTITION BY conv_id) AS whole FROM t),
w AS (SELECT min(conv_id) AS conv_id, n AS n_turns, count(*) AS copies, prefix FROM p WHERE n = whole GROUP BY n, prefix)
SELECT conv_id, n_turns, copies, prefix || '<|end|>' AS rendered FROM w
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.n < p.whole AND p.n = w.n_turns AND p.prefix = w.prefix)""",
    "op11_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INTEGER AS rank
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
    "op12_decontamination": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format(x="coalesce(text, '')")}, '{_WORD}') AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({_LOWER.format(x="coalesce(text, '')")}, '{_WORD}') AS w FROM benchmark),
iw AS (SELECT item, k, array_to_string(w[p:p + k - 1], ' ') AS win FROM (SELECT item, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM i WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT r, k, p, array_to_string(w[p:p + k - 1], ' ') AS win FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k)),
m AS (SELECT r, dw.k AS k, p, item FROM dw JOIN iw ON dw.k = iw.k AND dw.win = iw.win),
h AS (SELECT r, count(DISTINCT p + o) AS n FROM (SELECT r, p, unnest(range(0, k)) AS o FROM m) GROUP BY r),
n AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(n.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, h.n IS NOT NULL AS contaminated
FROM d LEFT JOIN h ON d.r = h.r LEFT JOIN n ON d.r = n.r""",
    "op13_fill_in_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '(?s)[A-Za-z]+|[^A-Za-z]') AS units, sha256('1:' || doc_id) AS h FROM documents),
r AS (SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
sha256(text) AS restored_sha256 FROM p""",
}
