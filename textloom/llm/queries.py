"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary, chat, linededup, minhash, mixing, packing, quality, sketch, suffixtree, tokens, toxicity
from .common import Scratch, table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokens.default_tokenizer(), capacity=2048, end_id=0)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), max_repeat=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = suffixtree.held_out(F.col("doc_id"), 4, 2)
    machine = toxicity.fit(docs, labels.where(~held))
    return toxicity.score(docs, machine, 0.3).select("doc_id", held.alias("held_out"), "score", "predicted")


def op6_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark).path("blocks")
    return binary.documents(binary.write(table(spark, sf_dir, "documents"), path, tokens.default_tokenizer(), end_id=0))


def op7_suffix_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtree.score(table(spark, sf_dir, "documents"), modulus=7, remainder=2)


def op8_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.edited_comparison(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = linededup.LineIndex.build(docs, min_docs=5, min_chars=40).dedup(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


PROBE = "</s>[INST] ok [/INST]"


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_chats(rows.unionByName(probe)))


QUERIES = {
    f.__name__: f
    for f in (op1_best_fit_packing, op2_quality_rules, op3_source_mixing, op4_minhash_near_dedup, op5_toxicity, op6_token_binary, op7_suffix_tree_scoring, op8_scaled_sketch, op9_line_dedup, op10_chat_formatting)
}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
FOLDED = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
STRIPPED = r"regexp_replace({0}, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"

ORACLE_SQL = {
    "op2_quality_rules": rf"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
        lines AS (SELECT r, source, unnest(string_split(text, chr(10))) AS line FROM docs),
        worded AS (SELECT r, coalesce(source, '') AS host, source IS NULL AS nohost, line, {FOLDED.format(STRIPPED.format("line"))} AS key, len({WORDS.replace("text", "line")}) AS n
            FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
        repeats AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM worded GROUP BY r),
        windows AS (SELECT r, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM docs WHERE len(w) >= 8)),
        twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS m FROM windows) WHERE m > 1),
        covered AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest(range(8)) AS k) GROUP BY r),
        held AS (SELECT r, host, nohost, key, sum(n) AS n FROM worded GROUP BY ALL),
        sets AS (SELECT r, list_sort(list(key)) AS line_set FROM held GROUP BY r),
        frequent AS (SELECT host, nohost, key FROM held JOIN sets USING (r) GROUP BY ALL HAVING count(DISTINCT line_set) > 20),
        lost AS (SELECT r, sum(n) AS n_lost_words FROM held JOIN frequent USING (host, nohost, key) GROUP BY r),
        found AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
                length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
                coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lost_words, 0)::BIGINT AS n_lost_words
            FROM docs LEFT JOIN repeats USING (r) LEFT JOIN covered USING (r) LEFT JOIN lost USING (r)),
        failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM found)
        SELECT *, NOT base_failed AND NOT (n_lost_words > 0 AND n_words - n_lost_words < 20 AND n_words - n_lost_words < 0.2 * n_words) AS kept FROM failed
    """,
    "op4_minhash_near_dedup": rf"""
        WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({FOLDED.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        sets AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM docs),
        sizes AS (SELECT doc_id, len(s) AS n FROM sets), held AS (SELECT doc_id, unnest(s) AS g FROM sets),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM held a JOIN held b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT doc_id, doc_id AS other FROM sizes UNION SELECT r.doc_id, b.b FROM reach r JOIN ways b ON b.a = r.other),
        named AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
        SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN named USING (doc_id)
    """,
    "op10_chat_formatting": rf"""
        WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
        marked AS (SELECT *, contains(text, '[/INST]') OR contains(text, '<s>') OR contains(text, '</s>') OR regexp_matches(text, '\[INST ([^\s\]]*)( esc)?\]') AS esc FROM said)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            (7 + sum(14 + length(url_encode(role)) + length(text) + CASE WHEN esc THEN 4 + 2 * length(text) - length(translate(text, '\[<', '')) - length(text) ELSE 0 END))::BIGINT AS formatted_chars
        FROM marked GROUP BY conv_id
    """,
    "op9_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, n, line,
                   translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents)
        ), repeated AS (
            SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40
            GROUP BY key HAVING count(DISTINCT doc_id) >= 5
        ), marked AS (
            SELECT l.*, r.key IS NOT NULL AND l.doc_id <> r.keeper AS lost FROM lines l LEFT JOIN repeated r USING (key)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT lost), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
}
