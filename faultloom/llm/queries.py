"""The operators over the driver's tables, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultloom.llm import ann, chat, exact, gains, interactions, jaccard, langid, mixing, packing, resample, secret_scan, simhash, warc
from faultloom.llm.common import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.formatted(turns.unionByName(extra), chat.INSTRUCTIONS))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.learn(docs), carry={"doc_id": F.col("doc_id"), "held_out": langid.held_out("doc_id")})


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


def op7_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"), "id % 100 = 0")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op9_secret_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.span_digest(secret_scan.secret_spans(table(spark, sf_dir, "documents")))


def op10_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), TOKENIZER)


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(table(spark, sf_dir, "documents"))


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gains.drawn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _hidden(x: str) -> str:
    """Characters of ``x`` with one backslash more for each backslash and control string."""
    controls = [("<s>", 3), ("</s>", 4), ("[INST]", 6), ("[/INST]", 7), ("\\", 1)]
    return f"length({x})" + "".join(f" + (length({x}) - length(replace({x}, '{c}', ''))) // {n}" for c, n in controls)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_language_id": op3_language_id,
    "op4_simhash": op4_simhash,
    "op5_importance_resampling": op5_importance_resampling,
    "op6_warc": op6_warc,
    "op7_kmeans_tree": op7_kmeans_tree,
    "op8_mix_sources": op8_mix_sources,
    "op9_secret_novelty": op9_secret_novelty,
    "op10_retrieval_packing": op10_retrieval_packing,
    "op11_filter_interactions": op11_filter_interactions,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_target_resampling": op13_target_resampling,
}

ORACLE: dict[str, str] = {
    "op1_chat_format": f"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN 14 ELSE 20 END + {_hidden("role")} + {_hidden("text")}) AS BIGINT) AS formatted_chars
        FROM c GROUP BY conv_id""",
    "op2_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {LOWER} AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY norm)""",
    "op6_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        f AS (SELECT page_id, html, CASE WHEN strlen(html) >= 100 THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS first FROM p)
        SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest,
               CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to
        FROM f""",
    "op11_filter_interactions": r"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
        l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
              FROM labels GROUP BY doc_id),
        f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, list_distinct([
                  CASE WHEN len(words) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' END,
                  CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 'C' END,
                  CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN first < w.doc_id THEN 'E' END]) AS fails
              FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
        n AS (SELECT part, good, toxic, list_sort(fails) AS fails, count(*) AS n FROM f GROUP BY ALL),
        e AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        o AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS names FROM e AS a, e AS b, e AS c, e AS d, e
              WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        s AS (SELECT array_to_string(names, '') AS filter_order, CAST(step AS INTEGER) AS step, names[step] AS f, names[1:step - 1] AS before
              FROM o, range(1, 6) AS r(step)),
        g AS (SELECT part, filter_order, step, f,
                     sum(CASE WHEN NOT list_has_any(fails, list_append(before, f)) THEN n ELSE 0 END) AS kept,
                     sum(CASE WHEN list_contains(fails, f) AND NOT list_has_any(fails, before) THEN n ELSE 0 END) AS removed,
                     sum(CASE WHEN list_contains(fails, f) AND list_has_any(fails, before) THEN n ELSE 0 END) AS redundant,
                     sum(CASE WHEN fails = [f] THEN n ELSE 0 END) AS unique_fails,
                     sum(CASE WHEN list_contains(fails, f) AND NOT list_has_any(fails, before) AND good = 1 THEN n ELSE 0 END) AS good_lost,
                     sum(CASE WHEN list_contains(fails, f) AND NOT list_has_any(fails, before) AND toxic = 1 THEN n ELSE 0 END) AS toxic_lost
              FROM n, s GROUP BY ALL)
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
               CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
        FROM g""",
    "op12_jaccard_join": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS words FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
                  ELSE list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' ')) END) AS gram FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s AS a JOIN s AS b ON a.gram = b.gram AND a.doc_id <> b.doc_id
                  JOIN n AS na ON na.doc_id = a.doc_id JOIN n AS nb ON nb.doc_id = b.doc_id
              GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 90 * (na.n + nb.n - count(*))),
        r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.reached)
        SELECT r.doc_id, coalesce(n, 0) AS n_shingles, min(reached) AS component_id
        FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id, n""",
}
