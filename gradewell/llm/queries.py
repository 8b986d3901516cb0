"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.llm import divergence, language, lines, mixing, neardup, quality, repeats, segmentation, token_counts, urls, vector_dedup, vector_search
from gradewell.llm.common import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars_left"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = segmentation.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = segmentation.decode(coded)
    return back.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), F.xxhash64("pieces").alias("pieces_hash"), F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), F.when(F.col("quality_score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.vector_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs)
    return language.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op10_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repeats.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_minhash, op2_line_dedup, op3_token_counts, op4_sentencepiece, op5_url_filter, op6_quality, op7_vector_dedup, op8_mixing, op9_language, op10_vector_search, op11_repeats, op12_divergence)}

#: Words and shingles compared by an equality join, and links closed by recursion: exact, and fit for small tables only.
_OP1 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * same >= 80 * (x.n + y.n - same)),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT e.a, r.c FROM r JOIN e ON e.b = r.id),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept FROM documents d JOIN m ON d.doc_id = m.id LEFT JOIN n ON d.doc_id = n.doc_id
"""
#: All variants of all lines.
_OP2 = r"""
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents),
w AS (SELECT doc_id, k, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM l),
f AS (SELECT w, min((doc_id, k)) AS first FROM w WHERE len(w) > 0 GROUP BY w),
v AS (SELECT first, unnest(list_concat(list_transform(range(len(w)), lambda i: array_to_string(w[1:i], ' ') || chr(10) || array_to_string(w[i + 2:], ' ')), list_transform(range(len(w) + 1), lambda i: array_to_string(w[1:i], ' ') || chr(10) || array_to_string(w[i + 1:], ' ')))) AS v FROM f WHERE len(w) >= 5),
e AS (SELECT v, min(first) AS earliest FROM v GROUP BY v),
g AS (SELECT DISTINCT first FROM v JOIN e USING (v) WHERE first <> earliest),
x AS (SELECT w.doc_id, w.k, w.line, len(w.w) > 0 AND ((w.doc_id, w.k) <> f.first OR g.first IS NOT NULL) AS gone FROM w LEFT JOIN f ON w.w = f.w LEFT JOIN g ON (w.doc_id, w.k) = g.first),
t AS (SELECT doc_id, count(*) FILTER (gone) AS n_dropped, string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone) AS text FROM x GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE len(string_split(d.text, chr(10))) END::BIGINT AS n_lines, coalesce(t.n_dropped, 0)::BIGINT AS n_dropped,
  CASE WHEN d.text IS NOT NULL THEN length(coalesce(t.text, '')) END::BIGINT AS n_chars_left, CASE WHEN d.text IS NOT NULL THEN md5(coalesce(t.text, '')) END AS text_md5 FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id
"""
_GOOD = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_OP7 = f"""
WITH RECURSIVE u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE {_GOOD} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT e.a, r.c FROM r JOIN e ON e.b = r.id),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id), k AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT t.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, m.c AS component_id, t.vec_id = m.c AS kept FROM embeddings t JOIN m ON t.vec_id = m.id LEFT JOIN k ON t.vec_id = k.a
"""
_OP10 = f"""
WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings WHERE {_GOOD}),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 20
"""
#: Every position's 50 bytes as hexadecimal digits; what is left is put together from the gaps between the runs.
_OP11 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT r, doc_id, o, substr(h, 2 * o + 1, 1122) AS h FROM (SELECT r, doc_id, h, unnest(range(0, len(h) // 2 - 49, 512)) AS o FROM d WHERE doc_id IS NOT NULL)),
p AS (SELECT r, doc_id, o + i AS i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT r, doc_id, o, h, unnest(range(len(h) // 2 - 49)) AS i FROM b)),
f AS (SELECT g, min(doc_id) AS m FROM p GROUP BY g),
c AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM p JOIN f USING (g) WHERE m < doc_id),
n AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM c),
s AS (SELECT r, k, min(i) AS lo, max(i) + 50 AS hi FROM n GROUP BY r, k),
w AS (SELECT r, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY r ORDER BY lo) AS before FROM s),
x AS (SELECT r, sum(hi - lo)::BIGINT AS gone, count(*) AS n, max(hi) AS last FROM w GROUP BY r),
k AS (SELECT w.r, string_agg(substr(d.h, (2 * w.before + 1)::BIGINT, (2 * (w.lo - w.before))::BIGINT), '' ORDER BY w.lo) AS h FROM w JOIN d ON w.r = d.r GROUP BY w.r)
SELECT d.doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, coalesce(x.gone, 0)::BIGINT AS n_removed, coalesce(x.n, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN x.r IS NULL THEN d.h ELSE k.h || substr(d.h, (2 * x.last + 1)::BIGINT) END)) AS kept_sha256
FROM d LEFT JOIN x ON d.r = x.r LEFT JOIN k ON d.r = k.r
"""

ORACLES = {"op1_minhash": _OP1, "op2_line_dedup": _OP2, "op7_vector_dedup": _OP7, "op8_mixing": mixing.ORACLE, "op10_vector_search": _OP10, "op11_repeats": _OP11, "op12_divergence": divergence.ORACLE}
