"""Registered queries over the driver tables, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import router
from textloom.functions import text as T
from textloom.operators import chunk, code, fuse, lexical, literal, materialize, quality, scan, state, vector
from textloom.plans import dev
from textloom.plans import schemas as S
from textloom.plans.engine import Index, chunks_of
from textloom.sources import corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
QUERY = "licensed under the"
PATTERN = r"\b[Ll]icensed? (under|by)\b"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def files(spark: SparkSession, d: str) -> DataFrame:
    return corpus.from_documents(table(spark, d, "documents"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunk.text_chunks(files(spark, d))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# Shared parts of the DuckDB statements.
NORM = r"lower(regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'))"
FILES = "files AS (SELECT source || '/' || doc_id || '.md' AS rel_path, coalesce(text, '') AS body FROM documents)"
LINES = FILES + r""", lines AS (SELECT rel_path, unnest(string_split_regex(regexp_replace(body, '\r?\n\z', ''), '\r?\n')) AS line,
    generate_subscripts(string_split_regex(regexp_replace(body, '\r?\n\z', ''), '\r?\n'), 1) AS line_number FROM files)"""
CHUNKS = (
    LINES
    + r""", segs AS (SELECT rel_path, line_number, generate_subscripts(string_split(line, ' :: '), 1) AS seg, unnest(string_split(line, ' :: ')) AS x FROM lines),
    raws AS (SELECT rel_path, line_number, seg, regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^(?:[-*+>] |#+ )\s*', '') AS raw FROM segs),
    longs AS (SELECT *, length(raw) >= 48 AS is_long FROM raws WHERE raw <> ''),
    begun AS (SELECT *, CASE WHEN is_long OR coalesce(lag(is_long) OVER w, true) THEN 1 ELSE 0 END AS st FROM longs WINDOW w AS (PARTITION BY rel_path ORDER BY line_number, seg)),
    islands AS (SELECT *, sum(st) OVER (PARTITION BY rel_path ORDER BY line_number, seg ROWS UNBOUNDED PRECEDING) - 1 AS ci FROM begun),
    chunks AS (SELECT rel_path, CAST(ci AS INTEGER) AS chunk_index, min(line_number) AS line_start, max(line_number) AS line_end,
        string_agg(raw, chr(10) ORDER BY line_number, seg) AS raw_text, """
    + NORM.format("string_agg(raw, chr(10) ORDER BY line_number, seg)")
    + " AS normalized_text FROM islands GROUP BY rel_path, ci)"
)
TOKENS = CHUNKS + r""", toks AS (SELECT *, list_filter(string_split_regex(strip_accents(lower(normalized_text)), '[^\p{L}\p{N}\p{Co}]+'), lambda t: t <> '') AS tk FROM chunks)"""


# The snippet of a text: at most 200 bytes of whole characters.
SNIP = "CASE WHEN octet_length(encode({0})) <= 200 THEN {0} ELSE left({0}, coalesce(list_max(list_filter(range(1, 201), lambda n: octet_length(encode(left({0}, n))) <= 200)), 0)) || '...' END"
TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def bm25_sql(words: list[str], where: str = "true", name: str = "lex") -> str:
    f = ", ".join(f"len(list_filter(tk, lambda t: t = '{w}')) AS f{i}" for i, w in enumerate(words))
    n = ", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(words)))
    idf = lambda i: f"CASE WHEN ln((docs - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((docs - n{i} + 0.5) / (n{i} + 0.5)) ELSE 1e-6 END"
    score = " + ".join(f"({idf(i)}) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl * docs / total))" for i in range(len(words)))
    cover = " + ".join(f"CASE WHEN contains(normalized_text, '{w}') THEN 1 ELSE 0 END" for w in words)
    hit = " OR ".join(f"f{i} > 0" for i in range(len(words)))
    return (
        f"{TOKENS}, freq AS (SELECT *, len(tk) AS dl, {f} FROM toks), stats AS (SELECT count(*) AS docs, sum(dl) AS total, {n} FROM freq), "
        f"{name}_all AS (SELECT freq.*, {score} AS bm25, ({cover}) / {len(words)}.0 AS cover FROM freq, stats WHERE ({hit}) AND ({where})), "
        f"{name} AS (SELECT *, cover + greatest(bm25, 0) AS lexical_score, row_number() OVER (ORDER BY round(bm25, 6) DESC, rel_path, chunk_index) - 1 AS rank FROM {name}_all ORDER BY round(bm25, 6) DESC, rel_path, chunk_index LIMIT 96)"
    )


# -- scans, admission, text functions ------------------------------------------------------------------------------


@query(f"WITH {LINES} SELECT rel_path, line_number, line FROM lines WHERE regexp_matches(line, '{PATTERN}')")
def regex_scan(spark, d):
    return scan.ordered(scan.regex_scan(corpus.line_rows(files(spark, d)), PATTERN))


@query(f"""WITH {LINES}, m AS (SELECT *, max(CASE WHEN regexp_matches(line, '{PATTERN}') THEN 1 ELSE 0 END)
    OVER (PARTITION BY rel_path ORDER BY line_number ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near FROM lines)
    SELECT rel_path, line_number, line FROM m WHERE near = 1""")
def regex_scan_context(spark, d):
    return scan.ordered(scan.with_context(corpus.line_rows(files(spark, d)), PATTERN, before=1, after=2))


@query(f"WITH {LINES} SELECT rel_path, line_number, line FROM lines WHERE contains(lower(line), 'licensed under')")
def literal_scan(spark, d):
    return scan.ordered(scan.literal_scan(corpus.line_rows(files(spark, d)), "Licensed Under"))


@query(f"""WITH {CHUNKS}, hits AS (SELECT * FROM lines WHERE contains(lower(line), 'licensed')),
    j AS (SELECT h.rel_path, h.line_number, h.line, c.chunk_index, row_number() OVER (PARTITION BY h.rel_path, h.line_number ORDER BY c.line_end - c.line_start, c.chunk_index) AS rn
    FROM hits h JOIN chunks c ON h.rel_path = c.rel_path AND h.line_number BETWEEN c.line_start AND c.line_end)
    SELECT rel_path, line_number, line, chunk_index FROM j WHERE rn = 1""")
def literal_to_chunk(spark, d):
    return literal.line_to_chunk(scan.literal_scan(corpus.line_rows(files(spark, d)), "licensed"), chunks(spark, d))


@query(f"""WITH {FILES}, f AS (SELECT rel_path, body, octet_length(encode(body)) AS size FROM files UNION ALL SELECT url, html, octet_length(encode(html)) FROM pages)
    SELECT CASE WHEN regexp_matches(rel_path, '\\.md$') THEN 'md' ELSE 'other' END AS kind, count(*) AS n,
    count(*) FILTER (size BETWEEN 1 AND 2097152) AS sized, count(*) FILTER (len(string_split(body, chr(10))) <= 100000) AS within FROM f GROUP BY 1""")
def admission_sizes(spark, d):
    pages = table(spark, d, "pages").select(F.col("url").alias("rel_path"), F.col("html").alias("body"))
    f = files(spark, d).unionByName(pages).withColumn("size", F.octet_length("body"))
    kind = F.when(F.col("rel_path").endswith(".md"), "md").otherwise("other")
    return f.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.col("size").between(1, S.MAX_FILE_BYTES)).alias("sized"), F.count_if(corpus.within_lines(F.col("body"))).alias("within"))


@query(f"WITH {FILES} SELECT rel_path, octet_length(encode(body)) AS size FROM files WHERE octet_length(encode(body)) BETWEEN 1 AND 2097152 AND NOT regexp_matches(body, '[\\x00-\\x08\\x0E-\\x1F\\x7F]')")
def admission_filter(spark, d):
    f = files(spark, d).withColumn("size", F.octet_length("body").cast("long"))
    return f.where(corpus.admitted(F.col("rel_path"), F.col("size")) & corpus.plain_text(F.col("body")) & corpus.within_lines(F.col("body"))).select("rel_path", "size")


@query(f"SELECT conv_id, turn, {NORM.format('text')} AS normalized, len(list_filter(string_split({NORM.format('text')}, ' '), lambda t: t <> '')) AS n_terms FROM conversations")
def normalize_terms(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", T.normalized(F.col("text")).alias("normalized"), F.size(T.terms(F.col("text"))).cast("long").alias("n_terms"))


@query(f"SELECT conv_id, turn FROM conversations WHERE contains({NORM.format('text')}, 'the') AND contains({NORM.format('text')}, 'ing')")
def matches_all_terms(spark, d):
    return table(spark, d, "conversations").where(T.matches_all(F.col("text"), F.lit("  The ING "))).select("conv_id", "turn")


@query(rf"""WITH {LINES} SELECT rel_path, line_number, regexp_replace((['- ', '* ', '> - ', '### ', '#', ''])[CAST(line_number % 6 AS INTEGER) + 1] || line, '^(?:[-*+>] |#+ )\s*', '') AS plain FROM lines""")
def decorator_strip(spark, d):
    marks = F.array(*[F.lit(m) for m in ("- ", "* ", "> - ", "### ", "#", "")])
    rows = corpus.line_rows(files(spark, d))
    return rows.select("rel_path", "line_number", T.undecorated(F.concat(F.element_at(marks, (F.col("line_number") % 6 + 1).cast("int")), "line")).alias("plain"))


@query(r"""SELECT DISTINCT event_type AS term, list_sort(list_distinct(list_concat([lower(event_type)], string_split_regex(lower(event_type), '[^a-z0-9]+')))) AS parts FROM events""")
def identifier_expand(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("term")).distinct()
    return e.select("term", F.array_sort(T.expand_identifier(F.col("term"))).alias("parts"))


# -- chunks --------------------------------------------------------------------------------------------------------


@query(f"WITH {CHUNKS} SELECT rel_path, chunk_index, line_start, line_end, raw_text, normalized_text FROM chunks")
def chunk_text(spark, d):
    return chunks(spark, d)


@query(f"WITH {CHUNKS} SELECT (SELECT count(*) FROM files) AS candidate_files, count(DISTINCT rel_path) AS indexable_files, count(*) AS chunk_count FROM chunks")
def chunk_estimate(spark, d):
    return chunk.estimate(files(spark, d), chunks(spark, d))


@query(f"WITH {CHUNKS} SELECT sha256(normalized_text) AS normalized_text_hash, normalized_text, count(*) AS ref_count FROM chunks GROUP BY normalized_text")
def shared_chunks(spark, d):
    return chunk.shared_chunks(chunks(spark, d))


@query(f"WITH {CHUNKS} SELECT rel_path, chunk_index, line_start, line_end, sha256(normalized_text) AS hash FROM chunks")
def chunk_refs(spark, d):
    c = chunks(spark, d)
    shared = chunk.shared_chunks(c)
    keyed = c.withColumn("normalized_text_hash", F.sha2("normalized_text", 256))
    return keyed.join(shared, ["normalized_text_hash", "normalized_text"]).select("rel_path", "chunk_index", "line_start", "line_end", F.col("normalized_text_hash").alias("hash"))


@query(f"WITH {CHUNKS} SELECT rel_path, count(*) AS n FROM chunks GROUP BY rel_path ORDER BY n DESC, rel_path LIMIT 10")
def top_files(spark, d):
    return dev.top_files(chunks(spark, d), 10)


@query(f"WITH {CHUNKS} SELECT normalized_text, count(*) AS ref_count FROM chunks GROUP BY 1 ORDER BY ref_count DESC, normalized_text LIMIT 10")
def top_shared(spark, d):
    return dev.top_shared(chunk.shared_chunks(chunks(spark, d)), "normalized_text", 10)


@query(f"WITH {CHUNKS} SELECT rel_path, count(*) AS chunks, count(DISTINCT normalized_text) AS shared FROM chunks GROUP BY 1")
def file_counts(spark, d):
    """Chunks and distinct texts of every file."""
    return chunks(spark, d).groupBy("rel_path").agg(F.count("*").alias("chunks"), F.count_distinct("normalized_text").alias("shared"))


@query("SELECT coalesce(lang, '<none>') AS key, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, key")
def key_counts(spark, d):
    return state.key_counts(table(spark, d, "documents"), "lang")


# -- lexical -------------------------------------------------------------------------------------------------------


@query(f"WITH {TOKENS}, u AS (SELECT rel_path, chunk_index, unnest(tk) AS token FROM toks) SELECT token, count(DISTINCT (rel_path, chunk_index)) AS df, count(*) AS tf FROM u GROUP BY token")
def tokenize_df(spark, d):
    return lexical.document_frequencies(chunks(spark, d))


@query(f"WITH {TOKENS} SELECT count(*) AS n_chunks, sum(len(tk))::BIGINT AS total_tokens FROM toks")
def corpus_stats(spark, d):
    return lexical.corpus_stats(chunks(spark, d))


def _lexical(spark, d, scope=None, kind="dir"):
    found = lexical.scores(lexical.counts(chunks(spark, d), QUERY), scope, kind)
    return rounded(found.select("rel_path", "chunk_index", "bm25", "lexical_score"), "bm25", "lexical_score")


_LEX = "SELECT rel_path, chunk_index, round(bm25, 6) AS bm25, round(lexical_score, 6) AS lexical_score FROM lex"


@query(f"WITH {bm25_sql(QUERY.split())} {_LEX}")
def bm25_root(spark, d):
    return _lexical(spark, d)


@query(f"WITH {bm25_sql(QUERY.split(), where='''rel_path LIKE 'src1/%' ''')} {_LEX}")
def bm25_dir(spark, d):
    return _lexical(spark, d, "src1")


@query(f"WITH {bm25_sql(QUERY.split(), where='''rel_path = 'src1/1.md' ''')} {_LEX}")
def bm25_file(spark, d):
    return _lexical(spark, d, "src1/1.md", "file")


@query(f"""WITH {TOKENS}, q AS (SELECT item_id AS query_id, unnest(list_filter(string_split_regex(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\\p{{L}}\\p{{N}}\\p{{Co}}]+'), lambda t: t <> '')) AS token FROM benchmark),
    want AS (SELECT query_id, token, count(*) AS times FROM q GROUP BY 1, 2),
    post AS (SELECT rel_path, chunk_index, dl, token, count(*) AS tf FROM (SELECT rel_path, chunk_index, len(tk) AS dl, unnest(tk) AS token FROM toks) GROUP BY ALL),
    df AS (SELECT token, count(*) AS n FROM post GROUP BY 1), st AS (SELECT count(*) AS docs, sum(len(tk)) AS total FROM toks),
    sc AS (SELECT query_id, rel_path, chunk_index, sum(CASE WHEN ln((docs - n + 0.5) / (n + 0.5)) > 0 THEN ln((docs - n + 0.5) / (n + 0.5)) ELSE 1e-6 END * times * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl * docs / total))) AS bm25
        FROM post JOIN want USING (token) JOIN df USING (token), st GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, rel_path, chunk_index) - 1 AS rank FROM sc)
    SELECT query_id, rel_path, chunk_index, round(bm25, 6) AS bm25, rank FROM r WHERE rank < 10""")
def search_batch(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return rounded(lexical.batch_candidates(chunks(spark, d), asked, 10), "bm25").select("query_id", "rel_path", "chunk_index", "bm25", F.col("rank").cast("long"))


# -- vectors -------------------------------------------------------------------------------------------------------


@query("""WITH b AS (SELECT item_id, encode('passage: ' || text) AS raw FROM benchmark),
    h AS (SELECT item_id, hex(raw) AS hx, octet_length(raw) AS n FROM b),
    e AS (SELECT item_id, unnest(range(n)) AS i, hx FROM h),
    v AS (SELECT item_id, i % 384 AS slot, sum(CAST('0x' || substr(hx, i * 2 + 1, 2) AS INTEGER) % 31 + 1) AS x FROM e GROUP BY 1, 2),
    g AS (SELECT item_id, s AS slot FROM b, range(384) r(s))
    SELECT item_id, slot, coalesce(x, 0)::DOUBLE AS x FROM g LEFT JOIN v USING (item_id, slot)""")
def det_embedding(spark, d):
    v = vector.embed(table(spark, d, "benchmark").select("item_id", "text"), "text")
    return v.select("item_id", F.posexplode("vector").alias("slot", "x")).select("item_id", F.col("slot").cast("long"), F.col("x").cast("double"))


_KNN = """WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
    s AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], q) AS vector_score FROM embeddings, q WHERE {0}),
    t AS (SELECT * FROM s ORDER BY round(vector_score, 6) DESC, vec_id LIMIT 96) SELECT vec_id, round(vector_score, 6) AS vector_score FROM t WHERE {1}"""


def _vectors(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))
    return v, v.where("vec_id = 0").first()["vector"]


@query(_KNN.format("true", "true"))
def knn_root(spark, d):
    v, q = _vectors(spark, d)
    return rounded(vector.nearest_arrow(v, "vec_id", q), "vector_score")


@query(_KNN.format("label < 3", "true"))
def knn_scoped(spark, d):
    v, q = _vectors(spark, d)
    return rounded(vector.nearest(v.join(v.where("label < 3").select("vec_id"), "vec_id", "left_semi"), "vec_id", q), "vector_score")


@query(_KNN.format("true", "vector_score >= 0.2"))
def knn_floor(spark, d):
    v, q = _vectors(spark, d)
    return rounded(vector.nearest(v, "vec_id", q, floor=S.MIN_VECTOR_SCORE), "vector_score")


@query(_KNN.format("true", "vector_score >= 0.2").replace("SELECT vec_id, round(vector_score, 6) AS vector_score FROM t WHERE", "SELECT e.vec_id AS ref, t.vec_id AS shared, round(vector_score, 6) AS vector_score FROM t JOIN embeddings e ON e.vec_id % 50 = t.vec_id WHERE"))
def knn_fanout(spark, d):
    v, q = _vectors(spark, d)
    best = vector.nearest(v, "vec_id", q).withColumnRenamed("vec_id", "shared")
    refs = v.select(F.col("vec_id").alias("ref"), (F.col("vec_id") % 50).alias("shared"))
    return rounded(vector.fan_out(best, refs, "shared"), "vector_score").select("ref", "shared", "vector_score")


# -- fusion and results --------------------------------------------------------------------------------------------

_FUSED = (
    bm25_sql(QUERY.split())
    + f""", lit_lines AS (SELECT * FROM lines WHERE contains(lower(line), '{QUERY}')),
    lit_j AS (SELECT h.rel_path, h.line_number, h.line, c.chunk_index, row_number() OVER (PARTITION BY h.rel_path, h.line_number ORDER BY c.line_end - c.line_start, c.chunk_index) AS rn
        FROM lit_lines h JOIN chunks c ON h.rel_path = c.rel_path AND h.line_number BETWEEN c.line_start AND c.line_end),
    lit AS (SELECT rel_path, chunk_index, min(line_number) AS line_number, arg_min(line, line_number) AS line FROM lit_j WHERE rn = 1 GROUP BY 1, 2),
    lit_r AS (SELECT *, row_number() OVER (ORDER BY string_split(rel_path, '/'), line_number) - 1 AS rank FROM lit),
    ch AS (SELECT rel_path, chunk_index, rank, lexical_score, 1 AS f, 0 AS r, NULL AS line_number, NULL AS line FROM lex
        UNION ALL SELECT rel_path, chunk_index, rank, 1.0, 0, 1, line_number, line FROM lit_r),
    fused AS (SELECT rel_path, chunk_index, sum(1.0 / (20 + rank)) AS score, max(lexical_score) AS lexical_score, max(f) AS f, max(r) AS r, max(line_number) AS lno, max(line) AS lline FROM ch GROUP BY 1, 2),
    final AS (SELECT * FROM fused ORDER BY r DESC, f + r DESC, f DESC, round(score, 9) DESC, round(lexical_score, 6) DESC, rel_path, chunk_index LIMIT 20)"""
)


@query(f"WITH {_FUSED} SELECT rel_path, chunk_index, round(score, 6) AS score, round(lexical_score, 6) AS lexical_score, f = 1 AS indexed_text_match, r = 1 AS partial_text_match FROM final")
def fuse_fts(spark, d):
    f = files(spark, d)
    hits = fuse.fuse(Index(f, chunk.text_chunks(f)).kept().channels(QUERY)).orderBy(*fuse.priority()).limit(S.RESULT_LIMIT)
    return rounded(hits.select("rel_path", "chunk_index", "score", "lexical_score", "indexed_text_match", "partial_text_match"), "score", "lexical_score")


@query(rf"""WITH {_FUSED}, shown AS (SELECT *, {TRIM.format("CASE WHEN r = 1 THEN lline ELSE raw_text END")} AS x FROM final JOIN chunks USING (rel_path, chunk_index))
    SELECT rel_path, CASE WHEN r = 1 THEN x ELSE {SNIP.format("x")} END AS snippet,
    CASE WHEN r = 1 THEN lno ELSE line_start END AS line_start, CASE WHEN r = 1 THEN lno ELSE line_end END AS line_end, CASE WHEN r = 1 AND f = 1 THEN 'rf' WHEN r = 1 THEN 'r' ELSE 'f' END AS channel_label FROM shown""")
def search_fts(spark, d):
    return flagship(spark, d).select("rel_path", "snippet", "line_start", "line_end", "channel_label")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    return Index(f, chunk.text_chunks(f)).kept().search(QUERY)


def embedded_sql(name: str, prefix: str, texts: str) -> str:
    """The deterministic embedding of a column of texts, as rows (text, slot, x) of what is not 0."""
    return f"""{name}_hex AS (SELECT text, hex(encode('{prefix}: ' || text)) AS hx FROM ({texts}) t),
    {name}_at AS (SELECT text, hx, unnest(range(length(hx) // 2)) AS i FROM {name}_hex),
    {name} AS (SELECT text, i % {S.VECTOR_DIMS} AS slot, sum(CAST('0x' || substr(hx, i * 2 + 1, 2) AS INTEGER) % 31 + 1)::DOUBLE AS x FROM {name}_at GROUP BY 1, 2)"""


_HYBRID_ORDER = "r DESC, (vector_score > 0)::INT + f + r DESC, f DESC, vector_score > 0 DESC, round(score, 9) DESC, round(lexical_score, 6) DESC, rel_path, chunk_index"


@query(rf"""WITH {_FUSED}, {embedded_sql("pv", "passage", "SELECT DISTINCT normalized_text AS text FROM chunks")}, {embedded_sql("qv", "query", f"SELECT '{QUERY}' AS text")},
    sims AS (SELECT pv.text, sum(pv.x * coalesce(qv.x, 0)) / (sqrt(sum(pv.x * pv.x)) * (SELECT sqrt(sum(x * x)) FROM qv)) AS vector_score FROM pv LEFT JOIN qv USING (slot) GROUP BY 1),
    best AS (SELECT text, vector_score FROM sims ORDER BY round(vector_score, 6) DESC, sha256(text) LIMIT 96),
    fan AS (SELECT rel_path, chunk_index, vector_score, row_number() OVER (ORDER BY round(vector_score, 6) DESC, sha256(text), rel_path, chunk_index) - 1 AS rank FROM chunks JOIN best ON normalized_text = text WHERE vector_score >= 0.2),
    ch3 AS (SELECT *, 0.0 AS vector_score FROM ch UNION ALL SELECT rel_path, chunk_index, rank, 0.0, 0, 0, NULL, NULL, vector_score FROM fan),
    hits AS (SELECT rel_path, chunk_index, sum(1.0 / (20 + rank)) AS score, max(lexical_score) AS lexical_score, max(vector_score) AS vector_score, max(f) AS f, max(r) AS r, max(line) AS lline FROM ch3 GROUP BY 1, 2 HAVING max(lexical_score) > 0 OR max(vector_score) > 0),
    capped AS (SELECT *, sum((lexical_score <= 0)::INT) OVER (ORDER BY {_HYBRID_ORDER} ROWS UNBOUNDED PRECEDING) AS n, bool_or(lexical_score > 0) OVER () AS any_lexical FROM hits),
    top AS (SELECT * FROM capped WHERE lexical_score > 0 OR n <= 5 OR NOT any_lexical ORDER BY {_HYBRID_ORDER} LIMIT 20),
    seen AS (SELECT top.*, {TRIM.format("CASE WHEN r = 1 THEN lline ELSE raw_text END")} AS x FROM top JOIN chunks USING (rel_path, chunk_index))
    SELECT rel_path, chunk_index, CASE WHEN r = 1 THEN x ELSE {SNIP.format("x")} END AS snippet, round(score, 6) AS score, round(lexical_score, 6) AS lexical_score, round(vector_score, 6) AS vector_score,
        CASE WHEN r = 1 THEN 'r' ELSE '' END || CASE WHEN f = 1 THEN 'f' ELSE '' END || CASE WHEN vector_score > 0 THEN 'v' ELSE '' END AS channel_label FROM seen""")
def search_hybrid(spark, d):
    f = files(spark, d)
    hits = Index.build(f, "fts+vector").kept().search(QUERY)
    return rounded(hits.select("rel_path", "chunk_index", "snippet", "score", "lexical_score", "vector_score", "channel_label"), "score", "lexical_score", "vector_score")


@query("""WITH h AS (SELECT label, vec_id, CASE WHEN vec_id % 40 = label THEN 1.0 ELSE 0.0 END AS lexical_score, 1.0 / (20 + vec_id) AS score FROM embeddings),
    r AS (SELECT *, sum(CASE WHEN lexical_score = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY lexical_score DESC, vec_id ROWS UNBOUNDED PRECEDING) AS n, max(lexical_score) OVER (PARTITION BY label) AS any_lexical FROM h)
    SELECT label, vec_id FROM r WHERE lexical_score > 0 OR n <= 5 OR any_lexical = 0""")
def semantic_cap(spark, d):
    """Hits of many queries: a label is a query, all embeddings are its hits."""
    lex = F.col("vec_id") % 40 == F.col("label")
    hits = table(spark, d, "embeddings").select("label", "vec_id", F.format_string("%020d", "vec_id").alias("rel_path"), F.lit(0).alias("chunk_index"), F.lit(0.0).alias("score"), F.when(lex, 1.0).otherwise(0.0).alias("lexical_score"), F.lit(0.5).alias("vector_score"), lex.alias("indexed_text_match"), F.lit(False).alias("partial_text_match"))
    return fuse.cap_semantic(hits, by=("label",)).select("label", "vec_id")


@query(rf"""WITH {CHUNKS}, hit AS (SELECT rel_path, chunk_index FROM chunks WHERE contains(normalized_text, 'licensed under')),
    shown AS (SELECT rel_path, chunk_index, line_start, line_end, {TRIM.format("raw_text")} AS x FROM chunks)
    SELECT h.rel_path, h.chunk_index, string_agg({SNIP.format("c.x")}, chr(10) ORDER BY c.chunk_index) AS snippet, min(c.line_start) AS line_start, max(c.line_end) AS line_end
        FROM hit h JOIN shown c ON h.rel_path = c.rel_path AND c.chunk_index BETWEEN h.chunk_index - 1 AND h.chunk_index + 1 GROUP BY 1, 2""")
def snippet_context(spark, d):
    c = chunks(spark, d)
    hits = c.where(F.contains("normalized_text", F.lit("licensed under"))).select("rel_path", "chunk_index", F.lit(None).cast("int").alias("literal_line_number"), F.lit(None).cast("string").alias("literal_preview"))
    return materialize.snippets(hits, c, 1, 1).select("rel_path", "chunk_index", "snippet", F.col("line_start").cast("long"), F.col("line_end").cast("long"))


@query("""WITH t AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS x FROM documents), p AS (SELECT doc_id, x, list_filter(range(1, 201), lambda n: octet_length(encode(left(x, n))) <= 200) AS fits FROM t)
    SELECT doc_id, CASE WHEN octet_length(encode(x)) <= 200 THEN x ELSE left(x, coalesce(list_max(fits), 0)) || '...' END AS snippet FROM p""")
def snippet_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query("""SELECT doc_id, CASE WHEN r || f || v = '' THEN '?' ELSE r || f || v END AS label, CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END AS lines
    FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'r' ELSE '' END AS r, CASE WHEN doc_id % 3 = 0 THEN 'f' ELSE '' END AS f, CASE WHEN doc_id % 5 = 0 THEN 'v' ELSE '' END AS v, doc_id % 4 AS a, doc_id % 4 + doc_id % 2 AS b FROM documents)""")
def channel_label(spark, d):
    i = F.col("doc_id")
    label = T.channel_label(i % 2 == 0, i % 3 == 0, F.when(i % 5 == 0, 0.5).otherwise(0.0))
    return table(spark, d, "documents").select("doc_id", label.alias("label"), T.line_label(i % 4, i % 4 + i % 2).alias("lines"))


# -- state ---------------------------------------------------------------------------------------------------------


def _snapshots(spark, d):
    f = table(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("rel_path"), "doc_id", F.col("n_chars").alias("size_bytes"))
    old = f.where("doc_id % 7 <> 0").withColumn("modified_unix_ms", F.lit(1000).cast("long"))
    new = f.where("doc_id % 5 <> 0").withColumn("modified_unix_ms", F.when(F.col("doc_id") % 3 == 0, 2000).otherwise(1000).cast("long"))
    return old, new


@query("""WITH p AS (SELECT source || '/' || doc_id || '.md' AS rel_path, doc_id FROM documents)
    SELECT rel_path, CASE WHEN doc_id % 7 = 0 THEN 'new' WHEN doc_id % 5 = 0 THEN 'deleted' WHEN doc_id % 3 = 0 THEN 'changed' ELSE 'unchanged' END AS status FROM p WHERE NOT (doc_id % 7 = 0 AND doc_id % 5 = 0)""")
def reconcile_diff(spark, d):
    return state.diff(*_snapshots(spark, d))


@query("""WITH o AS (SELECT source, count(*) AS was FROM documents WHERE doc_id % 7 <> 0 GROUP BY 1), n AS (SELECT source, count(*) AS now FROM documents WHERE doc_id % 5 <> 0 GROUP BY 1)
    SELECT source, coalesce(now, 0) - coalesce(was, 0) AS delta, coalesce(now, 0) > coalesce(was, 0) AS touched FROM o FULL JOIN n USING (source) WHERE coalesce(now, 0) <> coalesce(was, 0)""")
def refcount_delta(spark, d):
    t = table(spark, d, "documents").select("doc_id", "source")
    return state.count_deltas(t.where("doc_id % 7 <> 0"), t.where("doc_id % 5 <> 0"), "source")


@query("SELECT source, count(*) AS ref_count, count(*) FILTER (doc_id % 2 = 0) AS real FROM documents GROUP BY 1 HAVING count(*) <> count(*) FILTER (doc_id % 2 = 0)")
def refcount_invariant(spark, d):
    t = table(spark, d, "documents").select("doc_id", "source")
    return state.count_mismatches(t.groupBy("source").agg(F.count("*").alias("ref_count")), t.where("doc_id % 2 = 0"), "source")


@query(f"WITH {CHUNKS}, k AS (SELECT DISTINCT normalized_text FROM chunks) SELECT sha256(normalized_text) AS hash FROM k WHERE normalized_text NOT IN (SELECT normalized_text FROM chunks WHERE NOT rel_path LIKE 'src1/%')")
def gc_orphans(spark, d):
    c = chunks(spark, d).withColumn("hash", F.sha2("normalized_text", 256))
    return state.unreferenced(c.select("hash").distinct(), c.where(~T.in_scope(F.col("rel_path"), "src1")), "hash")


@query("SELECT vec_id, 4 * len(embedding) AS bytes, len(embedding) AS dims, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def vector_bytes(spark, d):
    """Vectors to bytes and back."""
    t = table(spark, d, "embeddings")
    dims = t.select(F.max(F.size("embedding"))).first()[0]
    raw = t.select("vec_id", vector.to_bytes(F.col("embedding")).alias("raw"))
    back = raw.select("vec_id", F.octet_length("raw").cast("long").alias("bytes"), vector.from_bytes(F.col("raw"), dims).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return back.select("vec_id", "bytes", F.size("v").cast("long").alias("dims"), F.round(total, 4).alias("total"))


@query("SELECT * FROM (VALUES ('index_level', 'fts+vector'), ('schema_version', '10'), ('chunk_mode', 'line+short-merge')) t(key, value)")
def upsert_settings(spark, d):
    old = spark.createDataFrame([("index_level", "fts"), ("schema_version", "10")], S.SETTINGS)
    return state.upserted(old, spark.createDataFrame([("index_level", "fts+vector"), ("chunk_mode", "line+short-merge")], S.SETTINGS))


@query("SELECT true AS dirty, 'changed' AS dirty_reason, 7::BIGINT AS last_sync_unix_ms")
def state_coalesce(spark, d):
    return state.next_state(spark.createDataFrame([(False, None, 7)], S.STATE), True, "changed", None)


@query(f"WITH {CHUNKS} SELECT (SELECT count(*) FROM files) AS files, count(*) AS chunks, count(DISTINCT normalized_text) AS shared, 0::BIGINT AS vectors, true AS fts_ready, false AS vector_ready FROM chunks")
def status_counts(spark, d):
    c = chunks(spark, d)
    return state.status(files(spark, d), c, chunk.shared_chunks(c), c, None)


@query("SELECT event_id AS run_id, event_type AS mode, user_id AS started_unix_ms, event_id AS finished_unix_ms, greatest(event_id - user_id, 0) AS duration_ms FROM events ORDER BY event_id DESC LIMIT 1")
def latest_run(spark, d):
    runs = table(spark, d, "events").select(F.col("event_id").alias("run_id"), F.col("event_type").alias("mode"), F.col("user_id").alias("started_unix_ms"), F.col("event_id").alias("finished_unix_ms"))
    return state.latest_run(runs)


@query("""WITH v AS (SELECT event_type, CAST(floor(value * 100) AS BIGINT) AS ms FROM events), s AS (SELECT event_type, list_sort(list(ms)) AS l, sum(ms)::BIGINT AS total, count(*) AS n FROM v GROUP BY 1)
    SELECT event_type, total, total // n AS mean, l[CAST(floor((n - 1) * 0.5 + 0.5) AS BIGINT) + 1] AS p50, l[CAST(floor((n - 1) * 0.95 + 0.5) AS BIGINT) + 1] AS p95 FROM s""")
def bench_percentiles(spark, d):
    v = table(spark, d, "events").select("event_type", F.floor(F.col("value") * 100).cast("long").alias("ms"))
    return state.nearest_rank(v, ["event_type"], "ms")


# -- evaluation ----------------------------------------------------------------------------------------------------


def _observed(spark, d):
    """Twenty consecutive documents are the hits of a case."""
    w = Window.partitionBy("case_id").orderBy("doc_id")
    t = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 20).cast("long").alias("case_id"), F.col("source").alias("rel_path"), F.coalesce("text", F.lit("")).alias("snippet"), "doc_id")
    return t.withColumn("rank", F.row_number().over(w)).drop("doc_id")


_OBSERVED = "o AS (SELECT doc_id // 20 AS case_id, source AS rel_path, coalesce(text, '') AS snippet, row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id) AS rank FROM documents)"
_EXPECTED = f"{_OBSERVED}, x AS (SELECT case_id, rel_path AS path, min(rank) AS first, arg_min(snippet, rank) AS snippet FROM o GROUP BY 1, 2), e AS (SELECT case_id, path, first <= 3 AND contains(snippet, 'the') AS passed FROM x)"
_COMPARED = "g AS (SELECT case_id, rank, CASE WHEN rank % 10 = 0 AND case_id % 3 = 0 THEN 'other' ELSE rel_path END AS rel_path FROM o), c AS (SELECT case_id, rank, coalesce(g.rel_path = o.rel_path, false) AS same FROM o FULL JOIN g USING (case_id, rank))"


def _expected(o):
    want = o.select("case_id", F.col("rel_path").alias("path")).distinct().select("case_id", "path", F.lit(3).alias("within_top"), F.lit("the").alias("snippet_contains"))
    return quality.expectations(want, o)


def _compared(o):
    g = o.withColumn("rel_path", F.when((F.col("rank") % 10 == 0) & (F.col("case_id") % 3 == 0), "other").otherwise(F.col("rel_path")))
    return quality.golden(g, o, ["rel_path"])


@query(f"WITH {_EXPECTED} SELECT case_id, path, passed FROM e")
def quality_expectations(spark, d):
    return _expected(_observed(spark, d))


@query(f"WITH {_OBSERVED}, {_COMPARED} SELECT case_id, rank, same FROM c")
def golden_diff(spark, d):
    return _compared(_observed(spark, d))


@query(f"""WITH {_EXPECTED}, {_COMPARED}, b AS (SELECT case_id, bool_or(NOT passed) AS bad_e FROM e GROUP BY 1), k AS (SELECT case_id, bool_or(NOT same) AS bad_g FROM c GROUP BY 1)
    SELECT count(*) AS cases, count(*) FILTER (NOT bad_e AND NOT bad_g) AS passed, count(*) FILTER (bad_e) AS failed_expectations, count(*) FILTER (bad_g) AS failed_golden FROM b JOIN k USING (case_id)""")
def quality_totals(spark, d):
    o = _observed(spark, d)
    return quality.totals(o.select("case_id").distinct(), _expected(o), _compared(o))


# -- checked by tests only -----------------------------------------------------------------------------------------


@query("""SELECT source, json_object('schema_version', 10, 'index_level', 'fts', 'files', count(*), 'bytes', sum(octet_length(encode(coalesce(text, '')))), 'dirty', count(*) FILTER (n_chars > 5000) > 0)::VARCHAR AS state FROM documents GROUP BY 1""")
def state_json(spark, d):
    """The state of one index a source, as JSON."""
    t = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("files"), F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes"), (F.count_if(F.col("n_chars") > 5000) > 0).alias("dirty"))
    return t.select("source", F.to_json(F.struct(F.lit(10).alias("schema_version"), F.lit("fts").alias("index_level"), "files", "bytes", "dirty")).alias("state"))


@query("SELECT * FROM (VALUES ('a.md', 1, 'needle'), ('b.md', 4, 'x')) t(path, line_number, line)")
def rg_json_events(spark, d):
    rows = ['{"type":"match","data":{"path":{"text":"a.md"},"lines":{"bytes":"bmVlZGxlCg=="}}}', '{"type":"context","data":{"path":{"text":"b.md"},"lines":{"text":"x\\n"},"line_number":4}}', '{"type":"end","data":{}}']
    return scan.parse_events(spark.createDataFrame([(r,) for r in rows], "value string"))


@query("SELECT * FROM (VALUES ('TODO|FIXME', true), ('C++', false), ('v1.2.3', false), ('colou?r{1,2}', true)) t(query, is_regex)")
def is_regex_router(spark, d):
    return spark.createDataFrame([(q, router.is_regex(q)) for q in ("TODO|FIXME", "C++", "v1.2.3", "colou?r{1,2}")], "query string, is_regex boolean")


_ROOTS = """p AS (SELECT DISTINCT unnest(['/' || source, '/' || source || '/' || doc_id % 10 || '/' || doc_id]) AS path FROM documents WHERE source IS NOT NULL),
    r AS (SELECT DISTINCT unnest(CASE WHEN doc_id % 10 < 3 THEN ['/' || source || '/' || doc_id % 10, '/' || source] ELSE ['/' || source || '/' || doc_id % 10 || '/' || doc_id] END) AS root FROM documents WHERE source <> 'src1')"""


def _paths_and_roots(spark, d):
    """Every source is a folder, with ten folders of documents; all but one source are indexed, some folders and documents, too."""
    t = table(spark, d, "documents").where("source IS NOT NULL").select("source", F.concat(F.lit("/"), "source").alias("a"), (F.col("doc_id") % 10).alias("k"), F.col("doc_id").cast("string").alias("i"))
    t = t.withColumn("b", F.concat_ws("/", "a", F.col("k").cast("string"))).withColumn("c", F.concat_ws("/", "b", "i"))
    roots = t.where("source <> 'src1'").select(F.explode(F.when(F.col("k") < 3, F.array("b", "a")).otherwise(F.array("c"))).alias("root"))
    return t.select(F.explode(F.array("a", "c")).alias("path")).distinct(), roots


@query(f"""WITH {_ROOTS} SELECT path, arg_max(root, length(root)) AS root FROM p LEFT JOIN r ON path = root OR starts_with(path, root || '/') GROUP BY path""")
def root_discovery(spark, d):
    return corpus.root_of(*_paths_and_roots(spark, d))


@query(f"""WITH {_ROOTS} SELECT path, root, 'ancestor' AS relation FROM p JOIN r ON path = root OR starts_with(path, root || '/')
    UNION ALL SELECT path, root, 'descendant' FROM p JOIN r ON starts_with(root, path || '/')""")
def roots_around(spark, d):
    """The roots above each document and folder, and those below each folder."""
    return corpus.roots_around(*_paths_and_roots(spark, d))


SOURCES = [("src/lib.rs", "/// parse docs\npub fn parse_query(input: &str) -> String {\n    let retry_backoff_ms = input.len();\n    retry_backoff_ms.to_string()\n}\n\npub struct Parser;\npub const DEFAULT_LIMIT: usize = 20;\n"), ("parser.py", "# alpha docs\nDEFAULT_LIMIT = 20\n\nclass Parser:\n    pass\n\ndef parse_query(input):\n    return input\n"), ("parser.ts", "interface ParserOptions {}\nconst makeParser = (input: string) => input;\nconst DEFAULT_LIMIT = 20;\n")]


@query("""SELECT * FROM (VALUES ('src/lib.rs', 'function', 2, 5), ('src/lib.rs', 'struct', 7, 7), ('src/lib.rs', 'constant', 8, 8), ('parser.py', 'constant', 2, 2), ('parser.py', 'class', 4, 5), ('parser.py', 'function', 7, 8),
    ('parser.ts', 'interface', 1, 1), ('parser.ts', 'function', 2, 2), ('parser.ts', 'constant', 3, 3)) t(rel_path, symbol_kind, line_start, line_end)""")
def code_symbols(spark, d):
    return code.symbol_chunks(spark.createDataFrame(SOURCES, "rel_path string, body string")).select("rel_path", "symbol_kind", "line_start", "line_end")


_SYMBOLS = """('src/lib.rs', 0, 2, 5, 'function'), ('src/lib.rs', 1, 7, 7, 'struct'), ('src/lib.rs', 2, 8, 8, 'constant'), ('parser.py', 0, 2, 2, 'constant'), ('parser.py', 1, 4, 5, 'class'),
    ('parser.py', 2, 7, 8, 'function'), ('parser.ts', 0, 1, 1, 'interface'), ('parser.ts', 1, 2, 2, 'function'), ('parser.ts', 2, 3, 3, 'constant')"""


@query(f"""WITH {CHUNKS} SELECT rel_path, chunk_index, line_start, line_end, 'text' AS chunk_kind, NULL::VARCHAR AS symbol_kind FROM chunks
    UNION ALL SELECT rel_path, chunk_index, line_start, line_end, 'symbol', symbol_kind FROM (VALUES {_SYMBOLS}) t(rel_path, chunk_index, line_start, line_end, symbol_kind)""")
def index_mixed(spark, d):
    """Chunks of all documents and of three files of code, whose symbols are fixed values."""
    more = spark.createDataFrame(SOURCES, "rel_path string, body string")
    return chunks_of(files(spark, d).unionByName(more)).select("rel_path", "chunk_index", "line_start", "line_end", "chunk_kind", "symbol_kind")
