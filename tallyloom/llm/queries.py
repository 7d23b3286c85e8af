"""The queries that __spark_entry__ registers for this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import chat_format, cross_polytope, decontam, langid, licenses, line_dedup, packing, quality, simhash, wavelet


def word_bpe() -> str:
    """The tokenizer that the contracts name."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.sql("SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return chat_format.format_conversations(rows.unionByName(own))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    return quality.classify(table(spark, sf_dir, "documents"), trusted)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.identify(docs.select("doc_id", "text"), langid.train_on_folds(docs))
    return out.select("doc_id", F.coalesce(langid.fold() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "languages")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), word_bpe(), capacity=4096)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_wavelet_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.round_trip(table(spark, sf_dir, "documents"), word_bpe())


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_chat_format, op3_quality, op4_language_id, op5_best_fit_packing, op6_decontamination, op7_wavelet_ids, op8_license_scan, op9_simhash, op10_embedding_dedup)}

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE = {
    "op1_line_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT r, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM d),
k AS (SELECT *, {_FOLD.format(f"trim(line, {_WS})")} AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY k.r, k.doc_id""",
    "op2_chat_format": """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
x AS (SELECT *, (length(t) - length(replace(t, chr(9243), ''))) + 2 * len(regexp_extract_all(t, '<\\|im_start\\|>|<\\|im_end\\|>|<\\|endoftext\\|>|</?s>|\\[/?INST\\]|<</?SYS>>')) AS more FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
       CAST(coalesce(sum(length(t)) FILTER (WHERE r = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
       CAST(sum(12 + length(r) + 1 + length(t) + more + 11) AS BIGINT) AS formatted_chars
FROM x GROUP BY conv_id""",
    # All pairs, whole: what the buckets must come to where their recall is 1, as it is on the registered tables.
    "op10_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) = len(list_filter(e, lambda x: isfinite(x))) AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g AS a JOIN g AS b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a), c AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least AS component_id, vec_id = least AS kept
FROM v JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id""",
}


def _license_sql() -> str:
    def form(text: str) -> str:
        x = f"lower({text})"
        for pattern in (licenses.COPYRIGHT, licenses.COPYRIGHT_C):
            x = f"regexp_replace({x}, '{pattern}', '\\1', 'g')"
        x = f"' ' || trim(regexp_replace({x}, '{licenses.OTHER}', '  ', 'g')) || ' '"
        for a, b in licenses.SAME:
            wide = lambda s: " " + s.replace(" ", "  ") + " "
            x = f"replace({x}, '{wide(a)}', '{wide(b)}')"
        return f"trim(replace({x}, '  ', ' '))"

    known = ", ".join(f"('{a}', '{b}')" for a, b in licenses.known_digests())
    names = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in licenses.notice_digests())
    return f"""
WITH f AS (SELECT doc_id, {form("coalesce(text, '')")} AS form,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(x) <= 200 AND (contains(lower(x), 'licen') OR contains(lower(x), 'cc0'))) AS near FROM documents),
n AS (SELECT doc_id, form, list_filter(list_transform(near, lambda x: CASE sha256({form("x")}) {names} END), lambda x: x IS NOT NULL) AS said FROM f),
d AS (SELECT doc_id, CASE WHEN form <> '' THEN sha256(form) END AS digest, nullif(array_to_string(list_sort(list_distinct(said)), ','), '') AS notices FROM n),
k AS (SELECT * FROM (VALUES {known}) AS t(digest, license))
SELECT doc_id, d.digest, license, notices FROM d LEFT JOIN k ON d.digest = k.digest"""


ORACLE["op8_license_scan"] = _license_sql()
