"""Registered queries of this subpackage, and their reference SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oscilla.llm import chat, exact_dedup, lexical, line_dedup, mixing, negatives, packing, quality, simhash, suffixes, token_count, topk, toxicity
from oscilla.llm.common import held_fold, table
from oscilla.session import ship_package

Plan = Callable[[SparkSession, str], DataFrame]

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2

PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def register(plan: Plan) -> Plan:
        @wraps(plan)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return plan(spark, sf_dir)

        PLANS[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return register


@query(
    "op1_exact_dedup",
    r"""
    WITH d AS (
      SELECT doc_id, length(coalesce(text, '')) AS chars,
             sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
      FROM documents),
    g AS (
      SELECT text_sha256, count(*) AS group_size, arg_min(doc_id, (-chars, doc_id)) AS keep_id
      FROM d GROUP BY text_sha256)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
    """,
)
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query(
    "op2_line_dedup",
    r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    w AS (
      SELECT doc_id, pos - 1 AS pos, array_to_string(lines[pos:pos + 2], chr(10)) AS win
      FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS pos FROM d)),
    r AS (
      SELECT doc_id, pos FROM w WHERE regexp_matches(win, '\S')
      QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) > 1),
    c AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM r),
    g AS (SELECT doc_id, list(pos) AS gone FROM c GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
           CASE WHEN gone IS NULL THEN text
                ELSE array_to_string(list_filter(lines, lambda x, i: NOT list_contains(gone, i - 1)), chr(10)) END AS text
    FROM d LEFT JOIN g ON d.doc_id = g.doc_id
    """,
)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fitted = toxicity.fit(docs, toxicity.training_labels(labels))
    scored = toxicity.score_toxicity(docs, fitted).withColumnRenamed("id", "doc_id")
    return scored.select(
        "doc_id",
        (held_fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        "evidence_ids",
        "evidence_cosines",
    )


@query("op5_best_fit_packing")
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)
    return packed.withColumnRenamed("id", "doc_id")


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path()).withColumnRenamed("id", "doc_id")


@query("op7_simhash_near_dedup")
def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op8_quality_classifier")
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = docs.select("doc_id", (held_fold(F.col("doc_id"), 3) == 1).alias("held_out"), quality.quality_score(docs, labels).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


@query(
    "op9_exact_top_k",
    """
    WITH e AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
    FROM s QUALIFY rank <= 20
    """,
)
def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.neighbours(table(spark, sf_dir, "embeddings"))


@query("op10_source_mixing")
def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.mix(table(spark, sf_dir, "documents"), target=0.999, repeats=2.0, tokenizer=tokenizer_path())
    return drawn.select(F.col("id").alias("doc_id"), "source", "tokens", "epoch", "block", "position")


@query(
    "op11_hard_negatives",
    """
    WITH e AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
             CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM e a JOIN e c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
    p AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank,
           vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    QUALIFY rank <= 10
    """,
)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), shifted)


PROBE = "</s>[INST] ok [/INST]"  # a text made of the template's own control strings


@query(
    "op12_chat_format",
    r"""
    WITH c AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
    o AS (
      SELECT *, lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
             len(regexp_extract_all(role || ' ' || text, '<\\*/?s>|\[\\*(/?SYS|/?INST|OUT|ROLE|TEXT)\]')) AS escapes
      FROM c)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(3 + sum(length(text) + escapes + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 10
                                                   ELSE 19 + length(role) END) AS BIGINT) AS formatted_chars,
           bool_and((before, role) IN (('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'),
                                       ('assistant', 'user'))) AS valid,
           valid AND last(role ORDER BY turn, role, text) = 'assistant' AS complete
    FROM o GROUP BY conv_id
    """,
)
def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], turns.schema)
    return chat.read_back(chat.format_conversations(turns.unionByName(probe)))


@query(
    "op13_lexical_search",
    r"""
    WITH t AS (
      SELECT rowid AS r, doc_id, unnest(regexp_extract_all(
               translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
      FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)),
    f AS (SELECT r, doc_id, term, count(*) AS tf FROM t GROUP BY r, doc_id, term),
    n AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM f GROUP BY r),
    c AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS len FROM n),
    d AS (SELECT term, count(*) AS df FROM f GROUP BY term),
    w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM d, c),
    i AS (
      SELECT DISTINCT item_id, unnest(regexp_extract_all(
               translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
      FROM benchmark),
    s AS (
      SELECT item_id, f.r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // len)))) AS BIGINT) AS score
      FROM i JOIN w USING (term) JOIN f USING (term) JOIN n ON n.r = f.r, c
      GROUP BY item_id, f.r, doc_id)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
    FROM s WHERE score > 0 QUALIFY rank <= 10
    """,
)
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return ranked.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def plans() -> dict[str, Plan]:
    return dict(PLANS)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
