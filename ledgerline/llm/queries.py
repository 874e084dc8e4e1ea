"""The registered queries of this subpackage, ``op<N>_<name>``, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from public_tokenizers import path as tokenizer_path

from .bpe_codec import decode, encode
from .collocations import collocations
from .embedding_dedup import near_vectors
from .fingerprints import fingerprints
from .minhash_dedup import near_duplicates
from .packing import pack
from .periodic_runs import periodic_runs, strongest
from .quality import quality_scores
from .substring_dedup import remove_repeats
from .token_counts import token_counts
from .toxicity import toxicity_scores
from .url_filter import url_verdicts
from .window_packing import pack_windows

#: The rules of the URL query: host, path, action.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "block"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "labels", "doc_id", "quality"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, URL_RULES)) + " AS r(host, path, action)")
    return url_verdicts(_table(spark, sf_dir, "pages", "page_id", "url"), rules)


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    encoded = encode(_table(spark, sf_dir, "documents", "doc_id", "text"), path).drop("text")
    hashed = encoded.select("doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), "token_ids")
    decoded = decode(hashed, path)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("word_bpe_49k.json"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("word_bpe_49k.json"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def _repeating(docs: DataFrame) -> DataFrame:
    """Texts of which each tenth, by the checksum of its id, ends in words that repeat."""
    sums = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    words = sums.withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    sized = words.withColumn("n", F.size("w")).withColumn("g", F.expr("h div 10"))
    placed = sized.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    ends = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return placed.select("doc_id", F.when(F.col("n") > 0, F.array_join(ends, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(_repeating(_table(spark, sf_dir, "documents", "doc_id", "text"))).withColumn("best", strongest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_windows(_table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("byte_bpe_50k.json"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents", "lang", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_toxicity": op3_toxicity,
    "op4_url_filter": op4_url_filter,
    "op5_bpe_codec": op5_bpe_codec,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_token_counts": op7_token_counts,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_fingerprints": op9_fingerprints,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_window_packing": op12_window_packing,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS shingle FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a),
m AS (SELECT a, min(c) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN m ON a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op10_embedding_dedup": r"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
e AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS c FROM v UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a),
m AS (SELECT a, min(c) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN m ON m.a = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op4_url_filter": r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(host, path, action) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
best AS (SELECT p.host, p.path, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.action, length(r.host || r.path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM p) p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.host, p.path)
SELECT page_id, p.host, p.path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN best ON p.host = best.host AND p.path = best.path""",
    "op8_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
r AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM g JOIN r USING (h)),
x AS (SELECT doc_id, list(k) AS gone FROM c GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(coalesce((SELECT string_agg(y.word, ' ' ORDER BY y.k) FROM (SELECT unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k) y WHERE NOT coalesce(list_contains(gone, y.k), false)), '')) AS kept_sha256
FROM w LEFT JOIN x ON w.doc_id = x.doc_id""",
    "op11_periodic_runs": r"""
WITH s AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o,
  xor(list_reduce(list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT), lambda c, b:
    list_reduce(range(0, 8), lambda v, j: xor(v >> 1, (v & 1) * 3988292384), xor(c, b)), 4294967295), 4294967295) AS h FROM documents),
t AS (SELECT *, len(o) AS m, h // 10 AS g FROM s),
u AS (SELECT *, g % nullif(m, 0) AS a, 1 + (m - g % nullif(m, 0)) // (3 + g % 8) AS p FROM t),
w AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND m > 0 THEN list_transform(range(0, m), lambda i: CASE WHEN i < a THEN o[i + 1] ELSE o[a + (i - a) % p + 1] END) ELSE o END AS ws FROM u),
-- 8 words that stand again q words later: a run's equal stretch is at least 16 long, so it holds such places one after the other
e AS (SELECT doc_id, i, array_to_string(ws[i + 1:i + 8], ' ') AS v FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 7)) AS i FROM w)),
d AS (SELECT doc_id, x.i, y.i - x.i AS q FROM e x JOIN e y USING (doc_id, v) WHERE x.i < y.i),
k AS (SELECT doc_id, q, min(i) AS start, count(*) + 7 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM d) GROUP BY doc_id, q, isle HAVING count(*) + 7 + q >= greatest(24, 3 * q)),
r AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM k z WHERE z.doc_id = k.doc_id AND z.q < k.q AND z.start <= k.start AND z.start + z.length >= k.start + k.length)),
b AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines,
  arg_min({'start': start, 'length': length, 'period': q}, {'a': -length::DOUBLE / q, 'b': start, 'c': q}) AS best FROM r GROUP BY doc_id),
x AS (SELECT doc_id, list(DISTINCT gone) AS gone FROM (SELECT doc_id, unnest(range(start + q, start + length)) AS gone FROM r) GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.period::BIGINT AS period, (1000 * best.length // best.period)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda z, i: NOT list_contains(gone, i - 1)) END, ' ')) AS collapsed_sha256
FROM w LEFT JOIN b ON w.doc_id = b.doc_id LEFT JOIN x ON w.doc_id = x.doc_id""",
    "op13_collocations": r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(regexp_split_to_array(s, '[.,;:!?\x0A-\x0D]')) AS piece FROM t)),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, 1 AS k, unnest(ws) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS a FROM g GROUP BY lang, k, phrase HAVING count(*) >= 10),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cuts AS (SELECT c.lang, c.phrase, c.k, c.a, cut, x.a AS l, y.a AS r, 1000000 * c.a * c.a // (x.a * y.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c JOIN f x ON x.lang = c.lang AND x.k = cut AND x.phrase = array_to_string(ws[:cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.k = c.k - cut AND y.phrase = array_to_string(ws[cut + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ AS (SELECT lang, phrase, max(a) AS longest FROM (SELECT lang, ws[1] || ' ' || ws[2] AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, ws[2] || ' ' || ws[3], a FROM c WHERE k = 3) GROUP BY lang, phrase)
SELECT best.lang, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, best.a DESC, encode(best.phrase)) AS rank, best.phrase, best.a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM best JOIN n USING (lang) LEFT JOIN inner_ ON inner_.lang = best.lang AND inner_.phrase = best.phrase
WHERE longest IS NULL OR 100 * longest < 50 * best.a QUALIFY rank <= 2000""",
}
