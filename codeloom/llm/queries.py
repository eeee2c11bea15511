"""The registered queries of this subpackage and what DuckDB can say about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import exact, exponion, mil, mixing, pieces, runs, sharding, simhash, substrings, urls, vectors

#: A public SentencePiece vocabulary; never copied into the repository.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Share of each source in the mix, in parts; sources not named have one part.
MIX_WEIGHTS = {"src0": 10}
#: (host, path, verdict).
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mil.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_permutation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.permutation_search(table(spark, sf_dir, "embeddings"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(table(spark, sf_dir, "documents"), MODEL)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.drop_repeats(table(spark, sf_dir, "documents")))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op6_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_ring(table(spark, sf_dir, "documents"), 40)
    return placed.selectExpr("doc_id", "size", "text_crc32", "'rows' AS law", "shard", "slot", "CAST(NULL AS INT) AS grown_shard")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mil.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_cosine_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.cosine_components(table(spark, sf_dir, "embeddings"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op10_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.pfair_mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS)


def op11_exponion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exponion.exponion_clusters(table(spark, sf_dir, "embeddings"))


def op12_perfect_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def planted_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where one document in ten, by the CRC-32 of its id, repeats a stretch of its words up to its end."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    n, a, p = F.col("n"), F.col("a"), F.col("p")
    cut = docs.where(h % 10 == 0).select("doc_id", words.alias("words"), F.floor(h / 10).alias("g")).withColumn("n", F.size("words").cast("long"))
    placed = cut.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.flatten(F.array_repeat(F.slice("words", (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
    text = F.array_join(F.concat(F.slice("words", F.lit(1), a.cast("int")), F.slice(again, F.lit(1), (n - a).cast("int"))), " ")
    rest = docs.where(F.coalesce(h % 10 != 0, F.lit(True))).select("doc_id", "text")
    return rest.unionByName(placed.select("doc_id", F.when(n > 0, text).alias("text")))


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.collapse_runs(planted_repeats(table(spark, sf_dir, "documents")))
    longest = F.get(F.array_sort("runs", lambda x, y: F.when(x.length != y.length, y.length - x.length).when(x.start != y.start, x.start - y.start).otherwise(x.period - y.period).cast("int")), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"))
    ratio = F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli")
    return best.select("doc_id", "n_runs", "best.start", "best.length", "best.period", ratio, "runs_sha256", "collapsed_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_permutation_search, op3_sentencepiece, op4_substring_dedup, op5_simhash, op6_hash_ring, op7_quality, op8_cosine_join, op9_url_rules, op10_pfair_mix, op11_exponion, op12_perfect_hash, op13_word_runs, pipeline)}


#: Fixed form of the URL rules for SQL, longest first.
_FITS = [
    ("example.org/en/1", "(host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/en/1')", "block"),
    ("example.org/es/", "(host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/es/')", "block"),
    ("com/fr/", "(host = 'com' OR suffix(host, '.com')) AND prefix(path, '/fr/')", "allow"),
    ("com/de/", "(host = 'com' OR suffix(host, '.com')) AND prefix(path, '/de/')", "block"),
    ("org/", "(host = 'org' OR suffix(host, '.org')) AND prefix(path, '/')", "allow"),
]

#: All subsets of a URL's tokens are counted outright, instead of by FP-growth.
OP9_SQL = f"""
WITH base AS (
  SELECT page_id, url,
    translate(CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1) ELSE '' END,
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
judged AS (
  SELECT page_id, host, path,
    CASE {' '.join(f"WHEN {c} THEN '{n}'" for n, c, _ in _FITS)} END AS rule,
    CASE {' '.join(f"WHEN {c} THEN '{v}'" for _, c, v in _FITS)} END AS told
  FROM base),
tokens AS (
  SELECT row_number() OVER () AS id, page_id, host, path, rule, told, list_sort(list_distinct(list_concat(
    list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x),
    list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'p:' || x)))) AS t
  FROM judged),
labelled AS (SELECT id, told, t, unnest(range(1, 1 << len(t))) AS mask FROM tokens WHERE told IS NOT NULL),
n AS (SELECT count(*) AS n FROM tokens WHERE told IS NOT NULL),
sets AS (SELECT id, told, list_transform(list_filter(list_zip(t, range(len(t))), lambda x: (mask >> x[2]) & 1 = 1), lambda x: x[1]) AS items FROM labelled),
freq AS (SELECT items, count(*) AS f FROM sets GROUP BY items),
rules AS (
  SELECT items, told AS verdict, count(*)::DOUBLE / any_value(f) AS confidence, count(*) AS n
  FROM sets JOIN freq USING (items) GROUP BY items, told
  HAVING count(*) >= ceil(0.01 * (SELECT n FROM n)) AND count(*)::DOUBLE / any_value(f) >= 0.9),
hits AS (
  SELECT k.id, r.verdict, row_number() OVER (PARTITION BY k.id ORDER BY r.confidence DESC, r.n DESC, r.verdict) AS nth
  FROM tokens k JOIN rules r ON list_has_all(k.t, r.items) WHERE k.told IS NULL)
SELECT k.page_id, k.host, k.path, k.rule, coalesce(k.told, h.verdict, 'allow') AS verdict
FROM tokens k LEFT JOIN hits h ON h.id = k.id AND h.nth = 1
"""

_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

#: Every window is compared with every other of the same words.
OP4_SQL = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS (
  SELECT doc_id, s, array_to_string(ws[s : s + 19], ' ') AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20)),
gone AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS nth FROM win) WHERE nth > 1),
cut AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM gone),
words AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN cut USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

_PAIRS = """
  SELECT a.vec_id AS a, b.vec_id AS b,
    list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dot,
    list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS cos
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
"""

#: All pairs, then reachability.
OP8_SQL = f"""
WITH RECURSIVE link AS (SELECT a, b FROM ({_PAIRS}) WHERE cos >= 0.9),
reach AS (SELECT a AS v, a AS w FROM (SELECT DISTINCT a FROM link) UNION SELECT r.v, l.b FROM reach r JOIN link l ON l.a = r.w),
low AS (SELECT v, min(w) AS component_id FROM reach GROUP BY v),
deg AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN deg ON a = vec_id LEFT JOIN low ON v = vec_id
"""


def _lloyd_sql(rounds: int) -> str:
    """Lloyd's algorithm with all distances, a round after the other."""
    nearest = """
  SELECT vec_id, v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (
    SELECT k.vec_id, k.v, c.cluster, list_sum(list_transform(list_zip(k.v, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept k, c{n} c)
  GROUP BY vec_id, v"""
    moved = """
c{m} AS (
  SELECT c.cluster, coalesce(n.c, c.c) AS c FROM c{n} c LEFT JOIN (
    SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM (
      SELECT cluster, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(len(v))) AS i FROM a{n}) GROUP BY cluster, i)
    GROUP BY cluster) n USING (cluster)),"""
    steps = "".join(f"\na{n} AS ({nearest.format(n=n)})," + (moved.format(n=n, m=n + 1) if n < rounds else "") for n in range(rounds + 1))
    return f"""
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster, v AS c FROM kept ORDER BY sha256('1:' || vec_id) LIMIT 16),{steps}
own AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM a{rounds} GROUP BY cluster)
SELECT vec_id, cluster::INT AS cluster, distance, cluster_inertia, (SELECT sum(distance)::BIGINT FROM a{rounds}) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN own USING (cluster) JOIN c{rounds} USING (cluster)
"""


OP12_SQL = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (
  SELECT doc_id, text_sha256, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, keep_id = doc_id AS kept, text_sha256 FROM g
"""

#: CRC-32 bit by bit; runs are stretches of positions whose six words come again the same number of words further on.
OP13_SQL = f"""
WITH w AS (
  SELECT doc_id, {_WORDS} AS ws,
    xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b:
      list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295), 4294967295) AS h
  FROM documents),
cut AS (SELECT doc_id, ws, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS planted, h // 10 AS g FROM w),
spot AS (SELECT *, CASE WHEN planted THEN g % n END AS a, CASE WHEN planted THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM cut),
x AS (SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: ws[(CASE WHEN i >= a THEN a + (i - a) % p ELSE i END) + 1]) ELSE ws END AS ws FROM spot),
gram AS (
  SELECT doc_id, i, dense_rank() OVER (ORDER BY doc_id, t) AS t FROM (
    SELECT doc_id, i, array_to_string(ws[i + 1 : i + 6], ' ') AS t FROM (SELECT doc_id, ws, unnest(range(n - 5)) AS i FROM x WHERE n >= 12))),
pairs AS (SELECT a.doc_id, a.i, b.i - a.i AS p FROM gram a JOIN gram b ON a.t = b.t AND a.i < b.i),
stretch AS (
  SELECT doc_id, p, min(i) AS s, max(i) + 6 AS e FROM (SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS z FROM pairs) GROUP BY doc_id, p, z),
runs AS (SELECT doc_id, s AS start, e + p - s AS length, min(p) AS period FROM stretch WHERE e - s >= p AND e - s + p >= 12 GROUP BY doc_id, s, e + p),
per AS (
  SELECT doc_id, count(*) AS n_runs, arg_max((start, length, period), (length, -start, -period)) AS best,
    sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256
  FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM (SELECT doc_id, unnest(ws) AS x, unnest(range(n)) AS i FROM x) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT x.doc_id, coalesce(n_runs, 0) AS n_runs, best[1] AS start, best[2] AS length, best[3] AS period, 1000 * best[2] // best[3] AS exponent_milli,
  coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM x LEFT JOIN per USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_substring_dedup": OP4_SQL, "op8_cosine_join": OP8_SQL, "op9_url_rules": OP9_SQL, "op11_exponion": _lloyd_sql(3), "op12_perfect_hash": OP12_SQL, "op13_word_runs": OP13_SQL,
    }
