"""The registered queries of the operators, at production parameters over whole tables, and their SQL."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tessitura.llm.decontaminate import contaminated, find_passages, hit_words
from tessitura.llm.html import extract_text
from tessitura.llm.jaccard import near_duplicates
from tessitura.llm.mixing import mix
from tessitura.llm.packing import pack
from tessitura.llm.periods import periodic_runs
from tessitura.llm.pii import KINDS, find_personal_data, written
from tessitura.llm.quality import held_out, score_quality
from tessitura.llm.suffix import repeated_spans
from tessitura.llm.tokens import END_ID, byte_level_path, read_tokens, write_tokens
from tessitura.llm.topk import top_k
from tessitura.llm.variants import count_words, spelling_variants
from tessitura.llm.warc import read_archives, write_archives
from tessitura.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, table(spark, sf_dir, "labels"), into="score", keep=["doc_id"])
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=90)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"), keep=["doc_id"])
    of = lambda k: F.size(F.filter("personal.base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *(of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)), F.sha2(written(F.col("personal.base")), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("personal.base", "personal.added"))).alias("spans"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_passages(docs, table(spark, sf_dir, "benchmark"))
    items = F.col("passages.items")
    return found.select(
        "doc_id", "passages.n_words", hit_words("passages").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"), contaminated("passages").alias("contaminated"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


def op8_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(table(spark, sf_dir, "documents"), digest=True)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op10_token_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), folder, byte_level_path(), END_ID)
    return read_tokens(spark, folder, ids=False)


def op11_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_words(table(spark, sf_dir, "documents"), typo=97, least=5).where("n >= 3")
    return spelling_variants(counts).select("word", "form", "root", "n", "n_near", "form_n")


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's texts: one document in ten repeats a part of itself to its end."""
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n or doc_id is None:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), rewrite=looped)
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    higher = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.reduce("runs", none, lambda best, r: F.when(higher(best, r), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    chosen = found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.expr("(1000 * best.length) div best.period")
    return chosen.select("doc_id", "n_runs", "best.*", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {
    "op1_exact_top_k": op1_exact_top_k,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_personal_data": op4_personal_data,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_html_extraction": op6_html_extraction,
    "op7_source_mixing": op7_source_mixing,
    "op8_warc_capture_index": op8_warc_capture_index,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_token_binary_output": op10_token_binary_output,
    "op11_sequence_packing": op11_sequence_packing,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_periodic_runs": op13_periodic_runs,
    "pipeline": corpus_pipeline.run,
}

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# crc32 of bytes: a table by its rule, then one look-up a byte.
CRC = """t AS MATERIALIZED (
  SELECT list(list_reduce(list_concat([k], range(8)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY k) t
  FROM (SELECT unnest(range(256)) k)
)"""
CRC32 = "xor(list_reduce(list_concat([4294967295], {}), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295)"

SQL = {
    "op1_exact_top_k": """
WITH v AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id query_id, c.vec_id, list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)])::BIGINT score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 10""",
    "op3_ngram_jaccard_join": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END s FROM w
), t AS (SELECT doc_id, len(s) n, unnest(s) g FROM s), p AS (
  SELECT a.doc_id a, b.doc_id b FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id
    AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r AS (
  SELECT doc_id AS node, doc_id AS reached FROM s
  UNION SELECT r.node, e.b FROM r JOIN e ON r.reached = e.a
)
SELECT s.doc_id, len(s.s)::BIGINT n_shingles, min(r.reached) component_id
FROM s JOIN r ON r.node = s.doc_id GROUP BY s.doc_id, s.s""",
    "op5_benchmark_decontamination": rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) n, unnest([array_to_string(w[i:i + least(13, len(w)) - 1], ' ')
    FOR i IN range(1, len(w) - least(13, len(w)) + 2)]) g FROM b WHERE len(w) > 0
), dw AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) i, w FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n
), o AS (
  SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON bw.n = dw.n AND bw.g = array_to_string(dw.w[dw.i:dw.i + dw.n - 1], ' ')
), h AS (
  SELECT doc_id, count(DISTINCT k) n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) k FROM o) GROUP BY doc_id
), f AS (
  SELECT doc_id, count(*) n_items, string_agg(item_id, ',' ORDER BY item_id) items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR item_id FROM o) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items,
  sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN f USING (doc_id)""",
    "op7_source_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT size,
    ('0x' || substr(md5('mix/' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE draw FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 weight FROM d GROUP BY source
), f AS (
  SELECT *, 3 * source_size AS full_size,
    ((sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o, 0))::DOUBLE
      / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE) lvl
  FROM s WINDOW o AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (
  SELECT *, first_value(lvl) OVER (ORDER BY full_size <= lvl * weight, full_size / weight, source NULLS LAST) water,
    bool_and(full_size <= lvl * weight) OVER () everything FROM f
), t AS (
  SELECT source, source_size, CASE WHEN everything THEN full_size::DOUBLE ELSE least(full_size::DOUBLE, water * weight) END target,
    ('0x' || substr(md5('mix/source/' || coalesce(source, '') || '/' || CASE WHEN source IS NULL THEN 'true' ELSE 'false' END), 1, 8))::BIGINT
      / 4294967296.0::DOUBLE u FROM g
), n AS (
  SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY floor(log2(size + 1) * 4), draw, size, doc_id::VARCHAR) k FROM d
)
SELECT doc_id, size, source_size, target,
  (size * least(3, CASE WHEN source_size > 0 THEN floor(k * (target / source_size) + u) - floor((k - 1) * (target / source_size) + u) ELSE 0 END))::BIGINT taken
FROM n JOIN t ON t.source IS NOT DISTINCT FROM n.source""",
    "op8_warc_capture_index": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT payload_bytes, sha1(coalesce(html, '')) h FROM pages
), g AS (SELECT h, max(page_id) newest FROM p GROUP BY h), v AS (
  SELECT p.*, newest, [('0x' || substr(p.h, 5 * k + 1, 5))::BIGINT FOR k IN range(8)] five FROM p JOIN g USING (h)
)
SELECT page_id, payload_bytes,
  array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> (15 - 5 * j)) & 31)::INTEGER + 1, 1) FOR j IN range(4)], '')
    FOR x IN five], '') payload_digest,
  CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END record_type,
  CASE WHEN page_id = newest THEN NULL ELSE newest END refers_to FROM v""",
    "op9_suffix_array_dedup": """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) h FROM documents
), w AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 200) g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) i FROM d)
), r AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) k FROM w
), b AS (
  SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END opens FROM r WHERE k > 1
), n AS (
  SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) span FROM b
), s AS (
  SELECT doc_id, span, min(i) a, max(i) + 100 z FROM n GROUP BY doc_id, span
), k AS (
  SELECT s.doc_id, s.span, s.a, s.z, coalesce(lag(z) OVER (PARTITION BY s.doc_id ORDER BY s.span), 0) p FROM s
), t AS (
  SELECT d.doc_id, d.h, coalesce(sum(k.z - k.a), 0)::BIGINT n_removed, count(k.a) n_spans, coalesce(max(k.z), 0) z,
    coalesce(string_agg(substr(d.h, 2 * k.p + 1, 2 * (k.a - k.p)), '' ORDER BY k.span), '') kept
  FROM d LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id, d.h
)
SELECT doc_id, (length(h) // 2)::BIGINT n_bytes, n_removed, n_spans,
  sha256(unhex(kept || substr(h, 2 * z + 1))) kept_sha256 FROM t""",
    "op12_spelling_variants": rf"""
WITH RECURSIVE {CRC}, r AS (
  SELECT doc_id, unnest(regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[A-Za-zÀ-ÿ]+')) r FROM documents
), u AS (SELECT doc_id, r, count(*) n FROM r GROUP BY doc_id, r), h AS (
  SELECT r, n, {CRC32.format("flatten([CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END FOR c IN string_split(doc_id || ':' || r, '')])")} h
  FROM u, t
), m AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, (h % length(r))::INTEGER) || substr(r, (h % length(r))::INTEGER + 2) ELSE r END AS word, n FROM h
), w AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT n FROM m WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), k AS MATERIALIZED (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) rest FROM (SELECT word, unnest(range(1, length(word) + 1)) i FROM w)
), p AS MATERIALIZED (
  SELECT a.word, b.word other FROM k a JOIN k b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT word, rest FROM k WHERE rest IN (SELECT word FROM w) UNION SELECT rest, word FROM k WHERE rest IN (SELECT word FROM w)
), b AS MATERIALIZED (
  SELECT p.word, count(*) n_near, first(p.other ORDER BY v.n DESC, p.other) other, max(v.n) m FROM p JOIN w v ON v.word = p.other GROUP BY p.word
), f AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT n_near, CASE WHEN m >= 2 * w.n THEN other END form, CASE WHEN m >= 2 * w.n THEN m END form_n
  FROM w LEFT JOIN b USING (word)
), c AS (
  SELECT word, coalesce(form, word) AS root FROM f UNION SELECT c.word, f.form FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM f JOIN c USING (word) JOIN f e ON e.word = c.root WHERE e.form IS NULL""",
    "op13_periodic_runs": rf"""
WITH {CRC}, o AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w,
    {CRC32.format("[ord(c) FOR c IN string_split(doc_id::VARCHAR, '')]")} h FROM documents, t
), a AS (SELECT *, len(w) n, h // 10 g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END a FROM o
), b AS (SELECT *, 1 + (n - a) // (3 + g % 8) p FROM a
), d AS MATERIALIZED (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE [w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1] FOR i IN range(n)] END w FROM b
), k AS MATERIALIZED (
  SELECT doc_id, n, unnest(range(n - 15)) i, unnest([array_to_string(w[i + 1:i + 16], ' ') FOR i IN range(n - 15)]) k FROM d WHERE n >= 24
), e AS (
  SELECT x.doc_id, y.i - x.i q, x.i FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.k = y.k AND x.i < y.i AND 3 * (y.i - x.i) <= x.n
), s AS (
  SELECT doc_id, q, min(i) AS start, max(i) - min(i) + 16 + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) island FROM e) GROUP BY doc_id, q, island
), r AS MATERIALIZED (
  SELECT doc_id, start, length, min(q) AS period FROM s WHERE length >= 24 AND length >= 3 * q GROUP BY doc_id, start, length
), f AS (
  SELECT doc_id, count(*) n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) lines FROM r GROUP BY doc_id
), m AS (
  SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) = 1
), g AS (
  SELECT doc_id, list(DISTINCT i) gone FROM (SELECT doc_id, unnest(range(start + period, start + length)) i FROM r) GROUP BY doc_id
), c AS (
  SELECT d.doc_id, string_agg(v, ' ' ORDER BY i) kept FROM (SELECT doc_id, unnest(w) v, unnest(range(n)) i FROM d) d
  LEFT JOIN (SELECT doc_id, unnest(gone) i, true gone FROM g) x USING (doc_id, i) WHERE gone IS NULL GROUP BY d.doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT n_runs, m.start, m.length, m.period, (1000 * m.length) // m.period exponent_milli,
  sha256(coalesce(lines, '')) runs_sha256, sha256(coalesce(kept, '')) collapsed_sha256
FROM d LEFT JOIN f USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN c USING (doc_id)""",
}

if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
