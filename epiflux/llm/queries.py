"""The registered queries of this subpackage, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epiflux.llm import (
    byte_bpe, conversation_repair, decontamination, exact_topk, host_quality, language_id, ngram_join, pii, secret_scan, simple8b, spelling, toxicity, url_filter,
)
from epiflux.llm.common import held_out, in_small_batches
from epiflux.session import scratch
from epiflux.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(run):
    @wraps(run)
    def with_settings(spark: SparkSession, folder: str) -> DataFrame:
        in_small_batches(spark)
        return run(spark, folder)

    QUERIES[run.__name__] = with_settings
    return run


@_query
def op4_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    hits = decontamination.find_hits(docs, table(spark, folder, "benchmark"))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLES["op4_benchmark_decontamination"] = r"""
WITH items AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS width, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
  FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0
), docs AS (
  SELECT row_number() OVER () AS n, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), hits AS (
  SELECT DISTINCT n, i, grams.width, item
  FROM (SELECT n, i, width, array_to_string(w[i:i + width - 1], ' ') AS gram
        FROM docs, (SELECT DISTINCT width FROM windows) AS widths, unnest(range(1, len(w) - width + 2)) AS t(i)) AS grams
  JOIN windows USING (width, gram)
), hit_words AS (
  SELECT n, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(0, width)) AS t(k) GROUP BY n
), hit_items AS (
  SELECT n, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT n, item FROM hits) GROUP BY n
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (n) LEFT JOIN hit_items USING (n)
"""


@_query
def op6_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    coded = byte_bpe.decode(byte_bpe.encode(docs).drop("text"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@_query
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    seen = ~held_out("doc_id", 5, 0)
    model = toxicity.fit(docs.filter(seen), table(spark, folder, "labels").filter(seen))
    return toxicity.score(docs, model).select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@_query
def op3_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, folder, "documents", "doc_id", "text"))


ORACLES["op3_jaccard_join"] = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM docs, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), links AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams x JOIN grams y USING (g) WHERE x.doc_id <> y.doc_id
    GROUP BY ALL
  ) JOIN sizes sa ON sa.doc_id = a JOIN sizes sb ON sb.doc_id = b WHERE 100 * c >= 80 * (sa.n + sb.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM docs UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM docs LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
  USING (doc_id)
"""


@_query
def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan(table(spark, folder, "documents", "doc_id", "text"), keep=["doc_id"])
    base = F.filter("secrets", lambda s: s["kind"] != "random")
    line = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",")
    number = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", number("assign").alias("n_assign"), number("access").alias("n_access"), number("hex").alias("n_hex"),
        F.sha2(line(base), 256).alias("base_sha256"), line(F.col("secrets")).alias("spans"),
    )


@_query
def op2_simple8b(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "simple8b")
    simple8b.write(table(spark, folder, "documents", "doc_id", "text"), path)
    return simple8b.read(spark, path).select(
        "doc_id", "start", "n_tokens", simple8b.ids_crc32("ids").alias("ids_crc32"))


@_query
def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text", "lang")
    model = language_id.fit(docs.filter(~held_out("doc_id", 3, 1)))
    return language_id.identify(docs.drop("lang"), model).select(
        "doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score", "rejected")


@_query
def op8_host_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text", "source")
    return host_quality.judge(docs, keep=["doc_id", "source"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLES["op8_host_quality"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, doc_id, source, coalesce(text, '') AS text,
         coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents
), lines AS (
  SELECT id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY id
), windows AS (
  SELECT id, i, count(*) OVER (PARTITION BY id, w[i], w[i + 1], w[i + 2]) AS times
  FROM docs, unnest(range(1, len(w) - 1)) AS t(i)
), repeats AS (
  SELECT id, count(DISTINCT i + k) AS n_repeat_words FROM windows, unnest(range(0, 3)) AS t(k) WHERE times > 1 GROUP BY id
), measures AS (
  SELECT id, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM docs LEFT JOIN lines USING (id) LEFT JOIN repeats USING (id)
), judged AS (
  SELECT *, base_failed OR 10 * n_symbols > 3 * n_words OR 100 * n_dup_lines > 50 * n_lines AS failed
  FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measures)
), hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (failed) AS k FROM judged WHERE source IS NOT NULL GROUP BY source
), moments AS (
  SELECT sum(k) / sum(n) AS rate, sum(n) - sum(n * n) / sum(n) AS free,
         sum(k * k / n) - sum(n) * (sum(k) / sum(n)) ** 2
           - (count(*) - 1) * (sum(k) / sum(n)) * (1 - sum(k) / sum(n)) AS excess
  FROM hosts
), prior AS (
  SELECT rate, CASE WHEN free > 0 AND excess / free > 0
                    THEN least(10000.0, greatest(2.0, rate * (1 - rate) / (excess / free) - 1)) ELSE 10000.0 END AS s
  FROM moments
), verdicts AS (
  SELECT source, m - 2 * sqrt(m * (1 - m) / (n + s + 1)) > 0.5 AS bad
  FROM (SELECT source, n, s, (k + rate * s) / (n + s) AS m FROM hosts, prior)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(bad, false) AS kept
FROM judged LEFT JOIN verdicts USING (source)
"""


URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


@_query
def op10_url_reputation(spark: SparkSession, folder: str) -> DataFrame:
    """A page's outcome is the label of the document that the number in its path names."""
    pages = table(spark, folder, "pages", "page_id", "url")
    labels = table(spark, folder, "labels").groupBy("doc_id").agg(
        F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    number = F.regexp_extract("url", r"://[^/?#]*/[a-z]+/([0-9]{1,18})", 1)
    known = pages.withColumn("doc_id", F.when(number != "", number.cast("long"))).join(labels, "doc_id", "left")
    return url_filter.judge(known, URL_RULES, bad="bad").select("page_id", "host", "path", "rule", "verdict")


ORACLES["op10_url_reputation"] = r"""
WITH parts AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         TRY_CAST(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]{1,18})', 1) AS BIGINT) AS doc_id
  FROM parts
), o AS (
  SELECT host, bad FROM p JOIN (
    SELECT doc_id, max(CAST(quality = 0 OR toxic = 1 AS INT)) AS bad FROM labels GROUP BY doc_id
  ) USING (doc_id) WHERE bad IS NOT NULL
), names AS (
  SELECT host, CASE WHEN len(string_split(host, '.')) > 2
                    THEN string_split(host, '.')[-2] || '.' || string_split(host, '.')[-1] ELSE host END AS domain,
         string_split(host, '.')[-1] AS suffix
  FROM (SELECT DISTINCT host FROM p)
), h AS (SELECT host, domain, suffix, count(*) AS n, sum(bad) AS k FROM o JOIN names USING (host) GROUP BY ALL),
levels AS (
  SELECT 'host' AS level, host AS name, n, k FROM h
  UNION ALL SELECT 'domain', domain, sum(n), sum(k) FROM h GROUP BY domain
  UNION ALL SELECT 'suffix', suffix, sum(n), sum(k) FROM h GROUP BY suffix
), moments AS (
  SELECT level, sum(k) / sum(n) AS rate, sum(n) - sum(n * n) / sum(n) AS free,
         sum(k * k / n) - sum(n) * (sum(k) / sum(n)) ** 2
           - (count(*) - 1) * (sum(k) / sum(n)) * (1 - sum(k) / sum(n)) AS excess
  FROM levels GROUP BY level
), priors AS (
  SELECT level, rate, least(10000.0, greatest(2.0, coalesce(
    CASE WHEN free > 0 AND excess / free > 0 THEN rate * (1 - rate) / (excess / free) - 1 ELSE 10000.0 END, 2.0))) AS s
  FROM moments
), s AS (
  SELECT name AS suffix, (k + rate * s) / (n + s) AS mean FROM levels JOIN priors USING (level) WHERE level = 'suffix'
), d AS (
  SELECT DISTINCT names.domain, (coalesce(l.k, 0) + coalesce(s.mean, ps.rate) * pd.s) / (coalesce(l.n, 0) + pd.s) AS mean
  FROM names LEFT JOIN levels l ON l.level = 'domain' AND l.name = names.domain LEFT JOIN s ON s.suffix = names.suffix
  JOIN priors ps ON ps.level = 'suffix' JOIN priors pd ON pd.level = 'domain'
), post AS (
  SELECT names.host, coalesce(h.n, 0) + ph.s AS weight, (coalesce(h.k, 0) + d.mean * ph.s) / (coalesce(h.n, 0) + ph.s) AS m
  FROM names JOIN d USING (domain) LEFT JOIN h ON h.host = names.host JOIN priors ph ON ph.level = 'host'
), ruled AS (
  SELECT p.*, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN m - 2 * sqrt(m * (1 - m) / (weight + 1)) > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled JOIN post USING (host)
"""


@_query
def op9_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    """The key of the query is public, so its surrogates hide nothing; a run of one's own takes a secret one."""
    found = pii.replace_checked(table(spark, folder, "documents", "doc_id", "text"), key="op9")
    return found.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), "entities")


@_query
def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    found = conversation_repair.repair(conversation_repair.damaged(rows)).withColumnRenamed("conv_id", "_conv_id")
    every = rows.select("conv_id").distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("_conv_id")), "left")
    numbers = [F.coalesce(name, F.lit(0)).cast("long").alias(name)
               for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(
        "conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@_query
def op13_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings", "vec_id", "embedding")
    return exact_topk.top_k(vectors, "vec_id", "embedding", asks=F.col("vec_id") % 50 == 0, k=5)


ORACLES["op13_exact_topk"] = r"""
WITH vectors AS (
  SELECT row_number() OVER () AS number, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT q.number, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.number <> c.number WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY number ORDER BY score DESC, vec_id ASC NULLS LAST) AS rank FROM scores
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@_query
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.group_variants(spelling.vocabulary(table(spark, folder, "documents", "doc_id", "text")))


#: The checksum is made of the table of its byte remainders; letters above 127 are two bytes from 0xC3 on.
ORACLES["op11_spelling_variants"] = r"""
WITH RECURSIVE bits AS (
  SELECT byte, 0 AS step, byte AS c FROM range(256) AS t(byte)
  UNION ALL
  SELECT byte, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE step < 8
), remainders AS (
  SELECT list(c ORDER BY byte) AS r FROM bits WHERE step = 8
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[a-zÀ-ÿ]{5,}')) AS run
  FROM documents
), counted AS (
  SELECT run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS name, count(*) AS times FROM runs GROUP BY ALL
), bytes AS (
  SELECT run, times, flatten(list_transform(string_split(name, ''), lambda x:
           CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)]
                ELSE [CAST(195 AS BIGINT), CAST(unicode(x) - 64 AS BIGINT)] END)) AS b
  FROM counted
), sums AS (
  SELECT run, times, xor(list_reduce(b, lambda c, x: xor(c >> 8, r[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS h
  FROM bytes, remainders
), words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
           times FROM sums
  ) WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3
), cuts AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM words, unnest(range(1, length(word) + 1)) AS t(i)
), near AS (
  SELECT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
  UNION SELECT cuts.word, words.word FROM cuts JOIN words ON cuts.cut = words.word
  UNION SELECT words.word, cuts.word FROM cuts JOIN words ON cuts.cut = words.word
), ranked AS (
  SELECT near.word, other, o.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near,
         row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, other) AS rank
  FROM near JOIN words o ON o.word = other
), forms AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form,
         CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
  FROM words LEFT JOIN ranked ON ranked.word = words.word AND rank = 1
), chains AS (
  SELECT word, word AS root FROM forms
  UNION SELECT chains.word, forms.form FROM chains JOIN forms ON forms.word = root WHERE form IS NOT NULL
)
SELECT forms.word, forms.form, root, forms.n, forms.n_near, forms.form_n
FROM forms JOIN chains ON chains.word = forms.word JOIN forms f ON f.word = root AND f.form IS NULL
"""
