"""Queries over the driver's tables for each operator, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import decompose as D
from ..operators import vector as V
from ..operators.embed import HashingProvider, embed_chunks
from ..sources import files as S
from ..streaming.intake import run_events
from . import events, hybrid, store
from .ingest import first_of_each, ingest, report
from .library import Library
from .storage import shared_folder
from .text_index import TextIndex
from .vector_index import VectorIndex

SMALL = C.ChunkConfig(40, 20)
AS_OF = datetime(2025, 1, 1)
TERMS = (["the", "and", "worthless", "der"], ["les", "pathetic", "of"])
NAMES = [".pdf", ".epub", ".png", ".jpg", ".jpeg", ".md", ".markdown", ".html", ".htm", ".txt", ".PDF", ""]
Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- leaves, tags and chunk vectors derived from the tables -------------------------------------


def leaf_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "text", "lang", "source", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    return first_of_each(rows, "doc_id").withColumn("leaf_id", F.col("content_hash"))


def leaves(spark: SparkSession, d: str) -> DataFrame:
    return _leaves_of(leaf_rows(spark, d))


def _leaves_of(rows: DataFrame) -> DataFrame:
    i = F.col("doc_id")
    status = F.when(i % 17 == 0, "error").when(i % 13 == 0, "processing").otherwise("ready")
    form = F.when(i % 3 == 0, "markdown").when(i % 3 == 1, "html").otherwise("plain_text")
    return rows.select("content_hash", "doc_id", F.concat("source", F.lit("/"), i.cast("string"), F.lit(".txt")).alias("source_path"), form.alias("format"), F.col("lang").alias("collection"), status.alias("status"), F.timestamp_add("MINUTE", i, F.lit(datetime(2024, 1, 1))).alias("updated_at"))


def leaf_tags(spark: SparkSession, d: str) -> DataFrame:
    return _tags_of(leaf_rows(spark, d), table(spark, d, "labels"))


def _tags_of(rows: DataFrame, labels: DataFrame) -> DataFrame:
    rows = rows.join(labels, "doc_id", "left")
    tags = F.array(F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality") == 1, "quality"), F.col("source"))
    return rows.select("leaf_id", F.explode(F.array_compact(tags)).alias("tag"))


def doc_segments(spark: SparkSession, d: str) -> DataFrame:
    return leaf_rows(spark, d).select("leaf_id", F.lit(0).alias("segment_index"), F.lit("section").alias("segment_label"), F.col("text").alias("content_text"))


def conversations_md(spark: SparkSession, d: str) -> DataFrame:
    turn = F.concat(F.lit("# "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), "text")
    parts = F.sort_array(F.collect_list(F.struct("turn", turn.alias("x"))))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["x"]), "\n").alias("text"))


def doc_library(spark: SparkSession, d: str) -> Library:
    rows = C.chunk_segments(doc_segments(spark, d)).withColumn("id", store.chunk_id("leaf_id", "segment_index", "chunk_index"))
    return Library(leaves(spark, d), doc_segments(spark, d).withColumn("id", store.chunk_id("leaf_id", "segment_index")), rows, leaf_tags(spark, d))


def vector_library(spark: SparkSession, d: str) -> Library:
    """A leaf L<label> for each label of embeddings, with a chunk for each vector."""
    e = table(spark, d, "embeddings")
    rows = e.select(F.col("vec_id").cast("string").alias("id"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("leaf_id"), F.lit(0).alias("segment_index"), F.col("vec_id").cast("int").alias("chunk_index"), F.lit("v").alias("chunk_label"), F.concat(F.lit("text "), F.col("vec_id").cast("string")).alias("content_text"), "embedding")
    labels = e.select("label").distinct()
    name = F.concat(F.lit("L"), F.col("label").cast("string"))
    ls = labels.select(name.alias("content_hash"), F.concat(F.lit("p/"), name).alias("source_path"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("collection"), F.when(F.col("label") == 9, "processing").otherwise("ready").alias("status"))
    tags = labels.select(name.alias("leaf_id"), F.explode(F.array_compact(F.array(F.when(F.col("label") % 2 == 0, "even").otherwise("odd"), F.when(F.col("label") < 3, "small")))).alias("tag"))
    return Library(ls, rows.select("leaf_id", "segment_index", F.lit("v").alias("segment_label")).distinct(), rows, tags)


LEAF = """leaf AS (SELECT * FROM (SELECT sha256(text) AS leaf_id, doc_id, text, lang, source, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1),
leaves AS (SELECT leaf_id AS content_hash, doc_id, source || '/' || doc_id || '.txt' AS source_path, CASE doc_id % 3 WHEN 0 THEN 'markdown' WHEN 1 THEN 'html' ELSE 'plain_text' END AS format, lang AS collection,
 CASE WHEN doc_id % 17 = 0 THEN 'error' WHEN doc_id % 13 = 0 THEN 'processing' ELSE 'ready' END AS status, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS updated_at FROM leaf),
tagged AS (SELECT leaf_id, unnest(list_filter([CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN quality = 1 THEN 'quality' END, source], lambda x: x IS NOT NULL)) AS tag FROM leaf LEFT JOIN labels USING (doc_id)),
doc_src AS (SELECT leaf_id, 'section' AS label, text FROM leaf)"""
MD = """md AS (SELECT conv_id, string_agg('# ' || role || ' ' || turn || chr(10) || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"""
TRIM = lambda x: rf"regexp_replace({x}, '\A{T.SPACE}+|{T.SPACE}+\z', '', 'g')"
RTRIM = lambda x: rf"regexp_replace({x}, '{T.SPACE}+\z', '')"


def classes_sql(src: str) -> str:
    """lines(leaf_id, i, line, n, t) and cls with score and kind of the texts of src."""
    return rf"""lines AS (SELECT leaf_id, i - 1 AS i, line, length(line) + 1 AS n, {TRIM('line')} AS t FROM (SELECT leaf_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {src})),
hashed AS (SELECT *, length(regexp_extract(t, '^(#{{1,6}})(?: |\z)', 1)) AS h FROM lines),
cls AS (SELECT leaf_id, i, line, n, t, CASE WHEN h > 0 THEN [100, 95, 90, 85, 85, 85][h] WHEN starts_with(t, '```') OR starts_with(t, '~~~') THEN 80 WHEN t = '' THEN 20 WHEN right(t, 1) IN ('.', '?', '!') THEN 10 ELSE 0 END AS score,
 CASE WHEN h > 0 THEN 1 WHEN starts_with(t, '```') OR starts_with(t, '~~~') THEN 2 WHEN t = '' OR right(t, 1) IN ('.', '?', '!') THEN 3 ELSE 0 END AS kind FROM hashed)"""


def chunks_sql(src: str, cfg: C.ChunkConfig) -> str:
    """CTEs that end in chunked(leaf_id, chunk_index, chunk_label, content_text) of src(leaf_id, label, text)."""
    good = lambda score, size: f"({score} * greatest(0.0, 1 - abs({size} - {cfg.target}) / {cfg.target}.0::DOUBLE) >= 10 OR {size} >= {cfg.target})"
    return f"""longer AS (SELECT * FROM {src} WHERE length(text) > {cfg.ceiling}), {classes_sql('longer')},
rec AS (SELECT leaf_id, -1::BIGINT AS i, 0::BIGINT AS st, 0::BIGINT AS sz, false AS open, -1::BIGINT AS a_s, -1::BIGINT AS a_e, -1::BIGINT AS b_s, -1::BIGINT AS b_e FROM longer
 UNION ALL SELECT leaf_id, i, CASE WHEN af THEN i + 1 ELSE st2 END, CASE WHEN af THEN 0 ELSE sz2 END, open2, CASE WHEN bf THEN st ELSE -1 END, CASE WHEN bf THEN i ELSE -1 END, CASE WHEN af THEN st2 ELSE -1 END, CASE WHEN af THEN i + 1 ELSE -1 END
 FROM (SELECT *, size >= {cfg.least} AND ((k2 = 3 AND {good('score2', 'size')}) OR (sz2 >= {cfg.least} AND sz2 >= {cfg.ceiling})) AS af
  FROM (SELECT *, CASE WHEN bf THEN i ELSE st END AS st2, CASE WHEN bf THEN n ELSE size END AS sz2
   FROM (SELECT *, k2 = 1 AND i > st AND sz >= {cfg.least} AND {good('score2', 'sz')} AS bf
    FROM (SELECT c.leaf_id, c.i, c.n, r.st, r.sz, r.sz + c.n AS size, CASE WHEN kind <> 2 AND open THEN 0 ELSE score END AS score2,
      CASE WHEN kind = 2 THEN (CASE WHEN open THEN 3 ELSE 1 END) WHEN open THEN 0 ELSE kind END AS k2, (kind = 2) <> open AS open2 FROM rec r JOIN cls c ON c.leaf_id = r.leaf_id AND c.i = r.i + 1))))),
cuts AS (SELECT leaf_id, a_s AS s, a_e AS e FROM rec WHERE a_s >= 0 UNION ALL SELECT leaf_id, b_s, b_e FROM rec WHERE b_s >= 0
 UNION ALL SELECT r.leaf_id, r.st, m.n FROM rec r JOIN (SELECT leaf_id, max(i) + 1 AS n FROM cls GROUP BY leaf_id) m ON m.leaf_id = r.leaf_id AND r.i = m.n - 1 WHERE r.st < m.n),
texts AS (SELECT c.leaf_id, c.s, {RTRIM("string_agg(l.line, chr(10) ORDER BY l.i)")} AS x FROM cuts c JOIN lines l ON l.leaf_id = c.leaf_id AND l.i >= c.s AND l.i < c.e GROUP BY c.leaf_id, c.s),
parts AS (SELECT leaf_id, s, x FROM texts WHERE x <> '' UNION ALL SELECT leaf_id, 0, text FROM {src} WHERE length(text) <= {cfg.ceiling}),
numbered AS (SELECT p.leaf_id, row_number() OVER (PARTITION BY p.leaf_id ORDER BY s) - 1 AS j, count(*) OVER (PARTITION BY p.leaf_id) AS n, label, x FROM parts p JOIN {src} q ON q.leaf_id = p.leaf_id),
chunked AS (SELECT leaf_id, 0::INT AS segment_index, j::INT AS chunk_index, CASE WHEN n > 1 THEN label || ' [' || (j + 1) || '/' || n || ']' ELSE label END AS chunk_label, x AS content_text FROM numbered)"""


# --- intake, lines and chunks ---------------------------------------------------------------------


@query(f"WITH {LEAF} SELECT leaf_id, doc_id FROM leaf")
def leaf_dedupe(spark, d):
    return leaf_rows(spark, d).select("leaf_id", "doc_id")


@query(f"WITH src AS (SELECT conv_id AS leaf_id, text FROM md), {classes_sql('src')} SELECT leaf_id AS conv_id, i::INT AS line, score::INT AS score FROM cls".replace("WITH ", f"WITH {MD}, ", 1))
def classify_lines(spark, d):
    rows = conversations_md(spark, d).select("conv_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "x"))
    return rows.select("conv_id", "line", C.classify_line(F.col("x"))["score"].alias("score"))


FENCED = "fenced AS (SELECT conv_id AS leaf_id, replace(replace(text, 'user', chr(10) || '```' || chr(10)), '.', '.' || chr(10)) AS text FROM md)"


def fenced_text() -> Column:
    return F.replace(F.replace(F.col("text"), F.lit("user"), F.lit("\n```\n")), F.lit("."), F.lit(".\n"))


@query(f"WITH {MD}, {FENCED}, {classes_sql('fenced')} SELECT leaf_id AS conv_id, i::INT AS line, CASE WHEN kind <> 2 AND open THEN 0 ELSE score END::INT AS score, open FROM (SELECT *, coalesce(sum(CASE WHEN kind = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY leaf_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS open FROM cls)")
def fence_state(spark, d):
    rows = conversations_md(spark, d).select("conv_id", F.posexplode(C.fence_states(F.split(fenced_text(), "\n", -1))).alias("line", "x"))
    return rows.select("conv_id", "line", "x.score", "x.open")


CHUNK_COLUMNS = "leaf_id, segment_index, chunk_index, chunk_label, content_text"


@query(f"WITH RECURSIVE {LEAF}, {chunks_sql('doc_src', C.ChunkConfig())} SELECT {CHUNK_COLUMNS} FROM chunked")
def chunk_documents(spark, d):
    return C.chunk_segments(doc_segments(spark, d))


@query(f"WITH RECURSIVE {LEAF}, {chunks_sql('doc_src', SMALL)} SELECT {CHUNK_COLUMNS} FROM chunked")
def chunk_small_cfg(spark, d):
    return C.chunk_segments(doc_segments(spark, d), SMALL)


@query(f"WITH RECURSIVE {MD}, {FENCED}, src AS (SELECT leaf_id::VARCHAR AS leaf_id, 'talk' AS label, text FROM fenced), {chunks_sql('src', SMALL)} SELECT {CHUNK_COLUMNS} FROM chunked")
def chunk_headings(spark, d):
    rows = conversations_md(spark, d).select(F.col("conv_id").cast("string").alias("leaf_id"), F.lit(0).alias("segment_index"), F.lit("talk").alias("segment_label"), fenced_text().alias("content_text"))
    return C.chunk_segments(rows, SMALL)


@query(f"WITH RECURSIVE {LEAF}, {chunks_sql('doc_src', C.ChunkConfig())} SELECT leaf_id, count(*) AS chunk_count FROM chunked GROUP BY leaf_id")
def chunk_counts(spark, d):
    return C.chunk_segments(doc_segments(spark, d)).groupBy("leaf_id").agg(F.count("*").alias("chunk_count"))


# --- decomposition --------------------------------------------------------------------------------

PLAIN = rf"""src AS (SELECT leaf_id, list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda p: {TRIM('p')}), lambda p: p <> '') AS ps FROM leaf),
rec AS (SELECT leaf_id, ps, 0::BIGINT AS i, []::VARCHAR[] AS parts, NULL::VARCHAR[] AS done FROM src
 UNION ALL SELECT leaf_id, ps, i + 1, CASE WHEN stays THEN list_append(parts, p) ELSE list_append(parts[k + 1:], p) END, CASE WHEN stays THEN NULL ELSE parts[1:k] END
 FROM (SELECT *, coalesce(len(parts) = 0 OR coalesce(list_sum(list_transform(parts, lambda x: strlen(x))), 0) + strlen(p) <= 1500 OR (strlen(p) <= 80 AND strlen(parts[-1]) <= 80), true) AS stays,
   coalesce(list_max(list_transform(range(1, len(parts) + 1), lambda j: CASE WHEN strlen(parts[j]) > 80 THEN j ELSE 1 END)), 1) AS k
  FROM (SELECT *, ps[i + 1] AS p FROM rec WHERE i < len(ps)))),
pieces AS (SELECT leaf_id, i, done AS g FROM rec WHERE done IS NOT NULL UNION ALL SELECT leaf_id, len(ps) + 1, parts FROM rec WHERE i = len(ps) AND len(parts) > 0),
firsts AS (SELECT leaf_id, i, g, {TRIM("regexp_replace(split_part(g[1], chr(10), 1), '^[- =#]+', '')")} AS f FROM pieces),
segs AS (SELECT leaf_id, (row_number() OVER (PARTITION BY leaf_id ORDER BY i) - 1)::INT AS segment_index, CASE WHEN f = '' OR strlen(f) > 80 THEN 'section' ELSE lower(f) END AS segment_label, array_to_string(g, chr(10) || chr(10)) AS content_text FROM firsts)"""


def _exploded(rows: DataFrame, key: str, found: Column) -> DataFrame:
    return rows.select(key, F.explode(found).alias("s")).select(key, "s.segment_index", "s.segment_label", "s.content_text")


@query(f"WITH RECURSIVE {LEAF}, {PLAIN} SELECT leaf_id, segment_index, segment_label, content_text FROM segs")
def segment_plain_text(spark, d):
    return _exploded(leaf_rows(spark, d), "leaf_id", D.plain_text(F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))))


@query(rf"WITH {LEAF}, x AS (SELECT leaf_id, {TRIM("regexp_replace(split_part('--- ' || text, chr(10), 1), '^[- =#]+', '')")} AS f FROM leaf) SELECT leaf_id, CASE WHEN f = '' OR strlen(f) > 80 THEN 'section' ELSE lower(f) END AS label FROM x")
def plain_text_label(spark, d):
    return leaf_rows(spark, d).select("leaf_id", D.plain_label(F.concat(F.lit("--- "), "text")).alias("label"))


@query(rf"""WITH {MD}, lines AS (SELECT conv_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM md),
marked AS (SELECT *, regexp_matches(line, '^{T.SPACE}*#{{1,6}}(?: |\z)') AS h FROM lines), numbered AS (SELECT *, sum(h::INT) OVER (PARTITION BY conv_id ORDER BY i) AS s FROM marked),
segs AS (SELECT conv_id, s, coalesce(max(CASE WHEN h THEN {TRIM("regexp_replace(line, '^" + T.SPACE + "*#{1,6}', '')")} END), 'preamble') AS label, {TRIM("coalesce(string_agg(CASE WHEN NOT h THEN line END, chr(10) ORDER BY i), '')")} AS text FROM numbered GROUP BY conv_id, s)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY s) - 1)::INT AS segment_index, label AS segment_label, text AS content_text FROM segs WHERE text <> ''""")
def segment_markdown(spark, d):
    return _exploded(conversations_md(spark, d), "conv_id", D.markdown(F.col("text")))


def entities_sql(x: str) -> str:
    for name, value in T.ENTITIES:
        x = f"replace({x}, '{name}', '{value.replace(chr(39), chr(39) * 2)}')"
    return x


def strip_sql(x: str) -> str:
    return entities_sql(f"replace(regexp_replace({x}, '<[^>]*>?', '', 'g'), '>', '')")


TAG = "(?is)" + "|".join(rf"<h{n}(?:>| [^>]*>).*?</h{n}>" for n in range(1, 7))


@query(rf"""WITH x AS (SELECT page_id, regexp_split_to_array(html, '{TAG}') AS b, regexp_extract_all(html, '{TAG}') AS t FROM pages),
y AS (SELECT page_id, t, unnest(b) AS body, generate_subscripts(b, 1) AS i FROM x),
z AS (SELECT page_id, i, CASE WHEN i = 1 THEN 'preamble' ELSE {TRIM(strip_sql('t[i - 1]'))} END AS label, {TRIM(strip_sql('body'))} AS text FROM y)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS segment_index, label AS segment_label, text AS content_text FROM z WHERE text <> ''""")
def segment_html(spark, d):
    return _exploded(table(spark, d, "pages"), "page_id", D.html(F.col("html")))


@query(f"SELECT page_id, {strip_sql('html')} AS text FROM pages")
def strip_tags(spark, d):
    return table(spark, d, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


@query(f"SELECT page_id, {entities_sql(chr(39) + '&amp;lt;b&gt; &quot;&#39;&apos;&nbsp;' + chr(39) + ' || url')} AS text FROM pages")
def decode_entities(spark, d):
    return table(spark, d, "pages").select("page_id", T.decode_entities(F.concat(F.lit("&amp;lt;b&gt; &quot;&#39;&apos;&nbsp;"), "url")).alias("text"))


PATHS = f"paths AS (SELECT page_id, 'a.b/' || page_id || {[n for n in NAMES]}[page_id % 12 + 1] AS path FROM pages)"


def paths(spark: SparkSession, d: str) -> DataFrame:
    name = F.get(F.array(*map(F.lit, NAMES)), (F.col("page_id") % 12).cast("int"))
    return table(spark, d, "pages").select("page_id", F.concat(F.lit("a.b/"), F.col("page_id").cast("string"), name).alias("path"))


@query(f"WITH {PATHS} SELECT page_id, 0 AS segment_index, regexp_extract(path, '[^/]*$') AS segment_label FROM paths")
def image_segments(spark, d):
    return _exploded(paths(spark, d), "page_id", D.image(F.col("path"))).drop("content_text")


@query(f"""WITH {PATHS}, e AS (SELECT page_id, regexp_extract(path, '/.+\\.([^./]*)$', 1) AS x FROM paths) SELECT page_id, CASE WHEN x IN ('md', 'markdown') THEN 'markdown' WHEN x IN ('html', 'htm') THEN 'html' WHEN x IN ('png', 'jpg', 'jpeg') THEN 'image' WHEN x IN ('pdf', 'epub') THEN x ELSE 'plain_text' END AS format,
x IN ('pdf', 'epub', 'png', 'jpg', 'jpeg', 'md', 'markdown', 'html', 'htm', 'txt') AS allowed FROM e""")
def format_dispatch(spark, d):
    return paths(spark, d).select("page_id", S.format_of(F.col("path")).alias("format"), S.allowed(F.col("path")).alias("allowed"))


# --- search ---------------------------------------------------------------------------------------

F16 = lambda x: f"CASE WHEN {x} = 0 THEN 0 ELSE round_even({x}::DOUBLE / pow(2.0, greatest(floor(log2(abs({x}::DOUBLE))), -14) - 10), 0) * pow(2.0, greatest(floor(log2(abs({x}::DOUBLE))), -14) - 10) END"
VECTORS = f"""v AS (SELECT vec_id, label, list_transform(embedding, lambda x: {F16('x')}) AS e FROM embeddings), q AS (SELECT e AS qe FROM v WHERE vec_id = 0),
scored AS (SELECT vec_id, label, list_dot_product(e, qe) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(qe, qe))) AS score FROM v, q WHERE label <> 9)"""
TOP = "SELECT vec_id::VARCHAR AS chunk_id, round(score, 6) AS score, 'text ' || vec_id AS content, 'L' || label AS leaf_id, 'p/L' || label AS source_path FROM scored WHERE {} ORDER BY scored.score DESC, 'L' || label, vec_id LIMIT {}"


def _search(spark: SparkSession, d: str, **options) -> DataFrame:
    q = table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]
    found = vector_library(spark, d).search(F.array(*(F.lit(float(x)) for x in q)), **options)
    return found.select("chunk_id", F.round("score", 6).alias("score"), "content", "citation.leaf_id", "citation.source_path")


@query(f"WITH {VECTORS} {TOP.format('true', 20)}")
def search_topk(spark, d):
    return _search(spark, d, limit=20)


@query(f"WITH {VECTORS} {TOP.format('label IN (1, 2, 9)', 5)}")
def search_filtered_collections(spark, d):
    return _search(spark, d, collections=["c1", "c2", "c9"])


@query(f"WITH {VECTORS} {TOP.format('label < 3 OR label % 2 = 1', 10)}")
def search_filtered_tags(spark, d):
    return _search(spark, d, tags=["small", "odd"], limit=10)


@query(f"WITH {VECTORS} {TOP.format('false', 5)}")
def search_empty_filter(spark, d):
    return _search(spark, d, collections=[])


def _index(spark: SparkSession, d: str) -> VectorIndex:
    chunks = vector_library(spark, d).chunks
    return VectorIndex.build(chunks, shared_folder(spark, "vector-index"), cells=16)


def _search_indexed(spark: SparkSession, d: str, **options) -> DataFrame:
    """All cells probed and a pool of all vectors: the exact result, by way of the index."""
    rows = table(spark, d, "embeddings")
    q = [float(x) for x in rows.where("vec_id = 0").first()["embedding"]]
    found = _index(spark, d).search(vector_library(spark, d), q, probes=None, pool=rows.count(), **options)
    return found.select("chunk_id", F.round("score", 6).alias("score"), "content", "citation.leaf_id", "citation.source_path")


@query(f"WITH {VECTORS} {TOP.format('true', 20)}")
def search_indexed(spark, d):
    return _search_indexed(spark, d, limit=20)


@query(f"WITH {VECTORS} {TOP.format('label IN (1, 2, 9) AND (label < 3 OR label % 2 = 1)', 10)}")
def search_indexed_filtered(spark, d):
    return _search_indexed(spark, d, collections=["c1", "c2", "c9"], tags=["small", "odd"], limit=10)


@query(f"SELECT vec_id, list_sum(list_transform(embedding, lambda x: {F16('x')} * 16777216))::BIGINT AS total FROM embeddings")
def f16_quantize(spark, d):
    scaled = F.transform("embedding", lambda x: V.f16(x) * 16777216)
    return table(spark, d, "embeddings").select("vec_id", F.aggregate(scaled, F.lit(0.0), lambda a, x: a + x).cast("long").alias("total"))


# --- listings and reads ---------------------------------------------------------------------------

LISTED = "SELECT content_hash, source_path, format, collection, status, updated_at, coalesce(chunk_count, 0) AS chunk_count, coalesce(tags, '') AS tags FROM top LEFT JOIN (SELECT leaf_id AS content_hash, count(*) AS chunk_count FROM chunked GROUP BY leaf_id) USING (content_hash) LEFT JOIN (SELECT leaf_id AS content_hash, string_agg(tag, ',' ORDER BY tag) AS tags FROM tagged GROUP BY leaf_id) USING (content_hash)"
DEFAULT = chunks_sql("doc_src", C.ChunkConfig())


def _listed(rows: DataFrame) -> DataFrame:
    return rows.select("content_hash", "source_path", "format", "collection", "status", "updated_at", "chunk_count", F.array_join("tags", ",").alias("tags"))


def _list_sql(where: str, limit: int) -> str:
    return f"WITH RECURSIVE {LEAF}, {DEFAULT}, top AS (SELECT * FROM leaves WHERE {where} ORDER BY updated_at DESC, content_hash LIMIT {limit}) {LISTED}"


@query(_list_sql("status = 'ready'", 200))
def leaves_list(spark, d):
    return _listed(doc_library(spark, d).list_leaves(status="ready", limit=500))


@query(_list_sql("format = 'html' AND status = 'error'", 50))
def leaves_by_format_status(spark, d):
    return _listed(doc_library(spark, d).list_leaves(format="html", status="error"))


@query(_list_sql("collection IN ('en', 'fr') AND content_hash IN (SELECT leaf_id FROM tagged WHERE tag IN ('toxic', 'src1'))", 50))
def leaves_by_tag(spark, d):
    return _listed(doc_library(spark, d).list_leaves(collections=["en", "fr"], tags=["toxic", "src1"]))


ONE = "one AS (SELECT leaf_id FROM leaf WHERE length(text) > 3072 ORDER BY doc_id LIMIT 1)"


def _one(spark: SparkSession, d: str) -> str:
    return leaf_rows(spark, d).where(F.length("text") > 3072).orderBy("doc_id").first()["leaf_id"]


@query(f"WITH RECURSIVE {LEAF}, {DEFAULT}, {ONE}, top AS (SELECT * FROM leaves WHERE content_hash IN (SELECT leaf_id FROM one)) {LISTED}")
def leaf_get(spark, d):
    return _listed(doc_library(spark, d).leaf(_one(spark, d)))


@query(f"WITH RECURSIVE {LEAF}, {PLAIN}, {ONE} SELECT segment_index, segment_label FROM segs WHERE leaf_id IN (SELECT leaf_id FROM one)")
def outline(spark, d):
    one = _one(spark, d)
    segments = _exploded(leaf_rows(spark, d).where(F.col("leaf_id") == one), "leaf_id", D.plain_text(F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))))
    lib = doc_library(spark, d)
    lib.segments = segments
    return lib.outline(one)


def _read_sql(mode: str, where: str) -> str:
    return f"WITH RECURSIVE {LEAF}, {DEFAULT}, {ONE} SELECT '{mode}' AS mode, string_agg(content_text, chr(10) || chr(10) ORDER BY chunk_index) AS content, count(*)::INT AS n FROM chunked WHERE leaf_id IN (SELECT leaf_id FROM one) AND {where} HAVING count(*) > 0"


def _read(spark: SparkSession, d: str, *place: int) -> DataFrame:
    return doc_library(spark, d).read(_one(spark, d), 0, *place).select("mode", "content", F.size("chunks").alias("n"))


@query(_read_sql("segment", "true"))
def read_segment(spark, d):
    return _read(spark, d)


@query(_read_sql("chunk", "chunk_index = 1"))
def read_chunk(spark, d):
    return _read(spark, d, 1)


@query(_read_sql("range", "chunk_index BETWEEN 0 AND 1"))
def read_range(spark, d):
    return _read(spark, d, 0, 1)


@query(f"WITH {LEAF} SELECT content_hash FROM leaves WHERE starts_with(content_hash, 'a') ORDER BY content_hash LIMIT 2")
def hash_prefix(spark, d):
    return doc_library(spark, d).by_prefix("a")


@query(f"WITH {LEAF} SELECT DISTINCT collection FROM leaves WHERE status = 'ready'")
def collections(spark, d):
    return doc_library(spark, d).collections()


# --- mutations ------------------------------------------------------------------------------------


@query(f"WITH {LEAF}, hit AS (SELECT content_hash FROM leaves WHERE doc_id % 5 = 0) SELECT leaf_id, tag FROM tagged WHERE leaf_id NOT IN (SELECT content_hash FROM hit) UNION ALL SELECT content_hash, unnest(['x', 'y']) FROM hit")
def tag_replace(spark, d):
    new = leaves(spark, d).where("doc_id % 5 = 0").select(F.col("content_hash").alias("leaf_id"), F.array(F.lit("x"), F.lit("x"), F.lit("y")).alias("tags"))
    return store.replace_tags(leaf_tags(spark, d), new)


def _full(rows: DataFrame) -> DataFrame:
    return rows.select("content_hash", "source_path", "format", F.lit(None).cast("string").alias("title"), "collection", F.lit(1).alias("segment_count"), "status", F.lit("old").alias("error"), F.col("updated_at").alias("created_at"), "updated_at")


@query(f"""WITH {LEAF} SELECT content_hash, source_path, format, collection, 1 AS segment_count, status, 'old' AS error, updated_at AS created_at, updated_at FROM leaves WHERE doc_id % 10 >= 3 AND doc_id % 10 < 8
UNION ALL SELECT content_hash, 'moved/' || source_path, CASE WHEN doc_id % 10 < 3 THEN format ELSE 'new' END, 'moved', 7, 'processing', NULL, CASE WHEN doc_id % 10 < 3 THEN updated_at ELSE TIMESTAMP '2025-01-01' END, TIMESTAMP '2025-01-01' FROM leaves WHERE doc_id % 10 < 3 OR doc_id % 10 >= 8""")
def leaf_upsert(spark, d):
    rows = leaves(spark, d)
    old = _full(rows.where("doc_id % 10 < 8"))
    new = _full(rows.where("doc_id % 10 < 3 or doc_id % 10 >= 8")).withColumns({"source_path": F.concat(F.lit("moved/"), "source_path"), "format": F.lit("new"), "collection": F.lit("moved"), "segment_count": F.lit(7)})
    return store.upsert_leaves(old, new, AS_OF).drop("title")


@query("SELECT vec_id::VARCHAR AS id, 'L' || label AS leaf_id FROM embeddings WHERE label NOT IN (3, 4)")
def purge_children(spark, d):
    lib = vector_library(spark, d)
    return store.purge(lib.chunks, lib.leaves.where("content_hash in ('L3', 'L4')").select(F.col("content_hash").alias("leaf_id"))).select("id", "leaf_id")


@query("SELECT vec_id::VARCHAR AS id, CASE WHEN vec_id < 300 THEN 'old' ELSE 'new' END AS content_text FROM embeddings")
def chunk_insert_ignore(spark, d):
    rows = vector_library(spark, d).chunks.select("id", "chunk_index")
    old, new = rows.where("chunk_index < 300").withColumn("content_text", F.lit("old")), rows.where("chunk_index >= 200").withColumn("content_text", F.lit("new"))
    return store.insert_ignore(old, new, ["id"]).select("id", "content_text")


@query(f"WITH {LEAF} SELECT content_hash, CASE WHEN doc_id < 600 THEN 'a' ELSE 'b' END AS store FROM leaves")
def merge_stores(spark, d):
    lib = doc_library(spark, d)
    part = lambda where, name: Library(lib.leaves.where(where).withColumn("store", F.lit(name)), lib.segments, lib.chunks, lib.leaf_tags)
    return store.merge(part("doc_id < 600", "a"), part("doc_id >= 400", "b")).leaves.select("content_hash", "store")


@query(f"WITH {LEAF} SELECT status, count(*) AS leaves, (SELECT count(*) FROM documents) - (SELECT count(*) FROM leaves) AS skipped FROM leaves GROUP BY status")
def ingest_report(spark, d):
    n = table(spark, d, "documents").count()
    rows = leaves(spark, d)
    return rows.groupBy("status").agg(F.count("*").alias("leaves")).withColumn("skipped", F.lit(n - rows.count()).cast("long"))


@query(f"WITH {LEAF} SELECT content_hash, CASE WHEN doc_id % 4 = 0 THEN 'error' ELSE status END AS status, CASE WHEN doc_id % 4 = 0 THEN 'broken' END AS error, CASE WHEN doc_id % 4 = 0 THEN TIMESTAMP '2025-01-01' ELSE updated_at END AS updated_at FROM leaves")
def leaf_mark(spark, d):
    rows = leaves(spark, d)
    hit = rows.where("doc_id % 4 = 0").select(F.col("content_hash").alias("leaf_id"))
    marked = store.mark(rows.withColumn("error", F.lit(None).cast("string")), "error", hit.unionByName(hit), AS_OF, "broken")
    return marked.select("content_hash", "status", "error", "updated_at")


@query("SELECT vec_id::VARCHAR AS id, CASE WHEN vec_id < 200 THEN 'old' ELSE 'new' END AS content_text FROM embeddings")
def segment_upsert(spark, d):
    rows = vector_library(spark, d).chunks.select("id", "chunk_index")
    old, new = rows.where("chunk_index < 300").withColumn("content_text", F.lit("old")), rows.where("chunk_index >= 200").withColumn("content_text", F.lit("new"))
    return store.upsert(old, new, ["id"]).select("id", "content_text")


@query(f"WITH RECURSIVE {LEAF}, {chunks_sql('doc_src', SMALL)} SELECT leaf_id, segment_index, chunk_index, chunk_label, coalesce(right(lag(content_text) OVER (PARTITION BY leaf_id ORDER BY chunk_index), 20), '') || content_text AS content_text FROM chunked")
def chunk_overlap(spark, d):
    return C.chunk_segments(doc_segments(spark, d), C.ChunkConfig(40, 20, 5))


@query(f"""WITH RECURSIVE {LEAF}, cut AS (WITH RECURSIVE {PLAIN} SELECT * FROM segs), named AS (SELECT leaf_id || '|' || segment_index AS leaf_id, segment_label AS label, content_text AS text FROM cut), {chunks_sql('named', C.ChunkConfig())}
SELECT (SELECT count(*) FROM documents) AS total, (SELECT count(*) FROM leaf) AS ingested, 0::BIGINT AS errors, (SELECT count(*) FROM cut) AS segments, (SELECT count(*) FROM chunked) AS chunks, (SELECT count(*) FROM documents) - (SELECT count(*) FROM leaf) AS skipped""")
def ingest_counts(spark, d):
    content = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")).cast("binary")
    rows = table(spark, d, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_path"), content.alias("content"), F.sha2(content, 256).alias("content_hash"), F.lit("plain_text").alias("format"))
    return report(rows, ingest(rows, AS_OF)).select("total", "ingested", "errors", "segments", "chunks", "skipped")


@query(f"WITH {LEAF} SELECT content_hash, CASE WHEN doc_id % 5 = 0 THEN 'de' ELSE collection END AS collection, CASE WHEN doc_id % 5 = 0 AND collection IS DISTINCT FROM 'de' THEN TIMESTAMP '2025-01-01' ELSE updated_at END AS updated_at FROM leaves")
def collection_move(spark, d):
    rows = leaves(spark, d)
    hit = rows.where("doc_id % 5 = 0").select(F.col("content_hash").alias("leaf_id"))
    return store.move_collection(rows, hit.unionByName(hit), "de", AS_OF).select("content_hash", "collection", "updated_at")


def _events(rows: DataFrame) -> DataFrame:
    """Two events for most leaves: a move, then a deletion of the new path or of the old one."""
    i = F.col("doc_id")
    new = F.concat(F.lit("new/"), "source_path")
    first = rows.where("doc_id % 3 < 2").select((2 * i).alias("event_id"), F.lit("moved").alias("event_type"), "content_hash", new.alias("path"))
    second = rows.where("doc_id % 4 < 2").select((2 * i + 1).alias("event_id"), F.lit("deleted").alias("event_type"), "content_hash", F.when(i % 4 == 0, new).otherwise(F.col("source_path")).alias("path"))
    return first.unionByName(second)


@query(f"""WITH {LEAF} SELECT content_hash, CASE WHEN doc_id % 3 < 2 THEN 'new/' ELSE '' END || source_path AS source_path,
CASE WHEN doc_id % 4 = 0 AND doc_id % 3 < 2 OR doc_id % 4 = 1 AND doc_id % 3 = 2 THEN 'gone' ELSE status END AS status,
CASE WHEN doc_id % 3 < 2 OR doc_id % 4 = 1 THEN TIMESTAMP '2025-01-01' ELSE updated_at END AS updated_at FROM leaves""")
def file_events(spark, d):
    rows = leaves(spark, d)
    return events.apply_events(rows, events.since(_events(rows), -1), AS_OF).select("content_hash", "source_path", "status", "updated_at")


# --- the store ------------------------------------------------------------------------------------


#: Folders of the rows of which stores are made: each append reads its own one.
SHARES = 8


def _stored_rows(spark: SparkSession, d: str) -> DataFrame:
    """leaf_rows, written once, in a folder for each share of the ids: texts are hashed and shuffled once, not by every table of every append."""
    path, rows = shared_folder(spark, "leaf-rows"), leaf_rows(spark, d).drop("leaf_id")
    rows = rows.withColumn("share", F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(SHARES)).cast("int"))
    rows.write.partitionBy("share").option("compression", store.CODEC).parquet(path)
    return spark.read.schema(rows.schema).parquet(path).withColumn("leaf_id", F.col("content_hash"))


def _store_library(rows: DataFrame, labels: DataFrame) -> Library:
    """Leaves of rows with a segment and a chunk for each, and their tags."""
    own = _leaves_of(rows).select("content_hash", "source_path", "format", F.lit(None).cast("string").alias("title"), "collection", F.lit(1).alias("segment_count"), F.lit(0).alias("skipped_segments"), "status", F.lit(None).cast("string").alias("error"), F.col("updated_at").alias("created_at"), "updated_at")
    segments = rows.select(store.chunk_id("leaf_id", F.lit("0")).alias("id"), "leaf_id", F.lit(0).alias("segment_index"), F.lit("section").alias("segment_label"), F.col("text").alias("content_text"))
    chunks = segments.select("id", F.col("id").alias("segment_id"), "leaf_id", "segment_index", F.lit(0).alias("chunk_index"), F.lit("section").alias("chunk_label"), "content_text")
    return Library(own, segments, chunks, _tags_of(rows, labels))


def _appended(spark: SparkSession, d: str) -> store.Store:
    """A store of nine appends, eight of which are merged; the last one sets a fifth of the leaves anew."""
    out, rows, labels = store.Store(spark, shared_folder(spark, "store")), _stored_rows(spark, d), table(spark, d, "labels")
    for i in range(SHARES):
        out.append(_store_library(rows.where(F.col("share") == i), labels))
    last = _store_library(rows.where("doc_id % 5 = 0"), labels)
    last.leaves = last.leaves.withColumns({"status": F.lit("error"), "updated_at": F.lit(AS_OF).cast("timestamp")})
    out.append(Library(last.leaves, *(getattr(last, t).where(F.lit(False)) for t in store.TABLES[1:])))
    return out


APPENDED = f"{LEAF}, now AS (SELECT content_hash, doc_id, CASE WHEN doc_id % 5 = 0 THEN 'error' ELSE status END AS status, CASE WHEN doc_id % 5 = 0 THEN TIMESTAMP '2025-01-01' ELSE updated_at END AS updated_at FROM leaves)"


@query(f"WITH {APPENDED} SELECT content_hash, status, updated_at, 1::BIGINT AS chunks, (SELECT count(*) FROM tagged WHERE leaf_id = content_hash) AS tags, 2 AS parts FROM now")
def store_appends(spark, d):
    kept = _appended(spark, d)
    lib = kept.load()
    count = lambda t, n: getattr(lib, t).groupBy(F.col("leaf_id").alias("content_hash")).agg(F.count("*").alias(n))
    rows = lib.leaves.join(count("chunks", "chunks"), "content_hash", "left").join(count("leaf_tags", "tags"), "content_hash", "left")
    return rows.select("content_hash", "status", "updated_at", "chunks", F.coalesce("tags", F.lit(0)).alias("tags"), F.lit(len(kept.parts())).alias("parts"))


@query(f"WITH {APPENDED} SELECT content_hash, status, updated_at, 1::BIGINT AS chunk_count FROM now ORDER BY updated_at DESC, content_hash LIMIT 50")
def leaves_recent(spark, d):
    return _appended(spark, d).recent().select("content_hash", "status", "updated_at", "chunk_count")


@query(f"WITH {LEAF} SELECT content_hash, CASE WHEN doc_id % 4 = 0 THEN 'processing' ELSE status END AS status, CASE WHEN doc_id % 4 < 2 THEN 0 ELSE 1 END::BIGINT AS segments FROM leaves WHERE doc_id % 4 <> 1")
def intake_states(spark, d):
    """A run that is at work, one that died and was repaired, and one that finished."""
    out, rows, labels = store.Store(spark, shared_folder(spark, "store")), _stored_rows(spark, d), table(spark, d, "labels")
    out.begin(_store_library(rows.where("doc_id % 4 = 1"), labels).leaves, "dead", now=0.0)
    out.begin(_store_library(rows.where("doc_id % 4 = 0"), labels).leaves, "at work")
    done = _store_library(rows.where("doc_id % 4 > 1"), labels)
    out.finish(out.begin(done.leaves, "done"), done)
    out.repair()
    lib = out.load()
    counts = lib.segments.groupBy(F.col("leaf_id").alias("content_hash")).agg(F.count("*").alias("segments"))
    return lib.leaves.join(counts, "content_hash", "left").select("content_hash", "status", F.coalesce("segments", F.lit(0)).alias("segments"))


class _Failing(HashingProvider):
    """Fails on texts that hold zz or xx."""

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        if any("zz" in t or "xx" in t for t in texts):
            raise ValueError("refused")
        return super().embed_batch(texts)


@query(f"""WITH RECURSIVE {LEAF}, cut AS (WITH RECURSIVE {PLAIN} SELECT * FROM segs), told AS (SELECT leaf_id, (contains(content_text, 'zz') OR contains(content_text, 'xx')) AS bad FROM cut),
per AS (SELECT leaf_id, count_if(NOT bad) AS kept, count_if(bad) AS lost FROM told GROUP BY leaf_id)
SELECT leaf_id AS doc_hash, CASE WHEN coalesce(kept, 0) = 0 AND coalesce(lost, 0) > 0 THEN 'error' ELSE 'ready' END AS status, coalesce(kept, 0)::INT AS segment_count, coalesce(lost, 0)::INT AS skipped_segments FROM leaf LEFT JOIN per USING (leaf_id)""")
def skipped_segments(spark, d):
    content = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")).cast("binary")
    rows = leaf_rows(spark, d).select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_path"), content.alias("content"), F.col("leaf_id").alias("content_hash"), F.lit("plain_text").alias("format"))
    found = ingest(rows, AS_OF, cfg=C.ChunkConfig(4096, 0), provider=_Failing(8), skip_segments=True).leaves
    return found.select(F.col("content_hash").alias("doc_hash"), "status", "segment_count", "skipped_segments")


@query(f"""WITH {LEAF} SELECT content_hash, CASE WHEN doc_id % 3 < 2 THEN 'new/' ELSE '' END || source_path AS source_path,
CASE WHEN doc_id % 4 = 0 AND doc_id % 3 < 2 OR doc_id % 4 = 1 AND doc_id % 3 = 2 THEN 'gone' ELSE status END AS status,
CASE WHEN doc_id % 3 < 2 OR doc_id % 4 = 1 THEN TIMESTAMP '2025-01-01' ELSE updated_at END AS updated_at FROM leaves""")
def event_stream(spark, d):
    """file_events by the stream: the moves in one run, the deletions in a later one."""
    kept, base = store.Store(spark, shared_folder(spark, "store")), shared_folder(spark, "events")
    rows = _stored_rows(spark, d)
    kept.commit(_store_library(rows, table(spark, d, "labels")))
    for kind in ("moved", "deleted"):
        _events(_leaves_of(rows)).where(F.col("event_type") == kind).write.mode("append").json(f"{base}/log")
        run_events(spark, f"{base}/log", kept, f"{base}/checkpoint", as_of=AS_OF)
    return kept.load().leaves.select("content_hash", "source_path", "status", "updated_at")


# --- extensions -----------------------------------------------------------------------------------

WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


@query(rf"WITH x AS (SELECT item_id, unnest({WORDS}) AS w FROM benchmark) SELECT item_id, (('0x' || substr(md5(w), 1, 8))::BIGINT % 64)::INT AS bucket, count(*)::DOUBLE AS value FROM x GROUP BY ALL")
def hash_embed(spark, d):
    rows = embed_chunks(table(spark, d, "benchmark").select("item_id", F.col("text").alias("content_text")), HashingProvider(64))
    return rows.select("item_id", F.posexplode("embedding").alias("bucket", "value")).where("value > 0").select("item_id", "bucket", F.col("value").cast("double"))


def _bm25_sql(terms: list[str], name: str) -> str:
    return f"""{name} AS (SELECT doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) AS score FROM (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(list_filter(w, lambda y: y IN {tuple(terms)})) AS term FROM tok) GROUP BY ALL)), (SELECT count(*) AS docs, avg(n) AS mean FROM tok) GROUP BY doc_id)"""


TOK = rf"tok AS (SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, {WORDS} AS w FROM documents))"


@query(f"WITH {TOK}, {_bm25_sql(TERMS[0], 'b')} SELECT doc_id, round(score, 6) AS score FROM b")
def bm25(spark, d):
    return hybrid.bm25(table(spark, d, "documents"), "doc_id", "text", TERMS[0]).withColumn("score", F.round("score", 6))


def _text_index(spark: SparkSession, d: str) -> TextIndex:
    """An index of two parts, so that statistics are summed over parts."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    index = TextIndex(spark, shared_folder(spark, "text-index"), "doc_id", "bigint")
    return index.append(docs.where("doc_id % 3 = 0"), "text").append(docs.where("doc_id % 3 <> 0 or doc_id is null"), "text")


@query(f"WITH {TOK}, {_bm25_sql(TERMS[0], 'b')} SELECT doc_id, round(score, 6) AS score FROM b")
def bm25_indexed(spark, d):
    return _text_index(spark, d).scores(TERMS[0]).withColumn("score", F.round("score", 6))


@query(f"WITH {TOK}, {_bm25_sql(TERMS[1], 'b')} SELECT doc_id, round(score, 6) AS score FROM b ORDER BY b.score DESC, doc_id LIMIT 50")
def bm25_indexed_best(spark, d):
    return _text_index(spark, d).search(TERMS[1], 50).withColumn("score", F.round("score", 6))


RANKED = lambda t: f"SELECT doc_id, 1.0 / (60 + row_number() OVER (ORDER BY round(score, 6) DESC, doc_id)) AS r FROM {t} ORDER BY round(score, 6) DESC, doc_id LIMIT 100"


@query(f"WITH {TOK}, {_bm25_sql(TERMS[0], 'b')}, {_bm25_sql(TERMS[1], 'c')}, u AS (SELECT * FROM ({RANKED('b')}) UNION ALL SELECT * FROM ({RANKED('c')})), s AS (SELECT doc_id, round(sum(r), 6) AS score FROM u GROUP BY doc_id) SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 20")
def hybrid_rrf(spark, d):
    docs = table(spark, d, "documents")
    parts = [hybrid.bm25(docs, "doc_id", "text", t).withColumn("score", F.round("score", 6)) for t in TERMS]
    return hybrid.fuse("doc_id", *parts, limit=200).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "doc_id").limit(20)


@query(f"""WITH {TOK}, {_bm25_sql(TERMS[0], 'b')}, top AS (SELECT doc_id, round(score, 6) AS first_score FROM b ORDER BY first_score DESC, doc_id LIMIT 100),
again AS (SELECT doc_id, first_score, len(list_filter({TERMS[0]}, lambda t: list_contains(w, t)))::DOUBLE / {len(TERMS[0])} AS score FROM top JOIN tok USING (doc_id))
SELECT doc_id, first_score, score FROM again ORDER BY score DESC, first_score DESC, doc_id LIMIT 20""")
def rerank(spark, d):
    docs = table(spark, d, "documents")
    found = hybrid.bm25(docs, "doc_id", "text", TERMS[0]).withColumn("score", F.round("score", 6))
    top = found.orderBy(F.desc("score"), "doc_id").limit(100)
    return hybrid.rerank(docs.select("doc_id", "text").join(F.broadcast(top), "doc_id"), "doc_id", "text", " ".join(TERMS[0])).select("doc_id", "first_score", "score")
