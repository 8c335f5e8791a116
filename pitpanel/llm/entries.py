"""The registered queries over the corpus tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .backoff_lm import score_documents
from .ball_simhash import simhash_groups
from .collocations import mine_collocations
from .common import table
from .crf_quality import quality_scores
from .decontaminate import contamination, items_digest
from .html_content import extract
from .mask_search import ranked_search
from .near_dedup import near_groups
from .packing import pack_documents
from .sharding import shard_documents
from .substring_dedup import remove_repeats
from .token_counts import count_tokens
from .weak_rules import quality_verdicts


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), 8).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "tokens",
    )


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), 4096)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", items_digest(F.col("items")).alias("items_sha256"), "contaminated"
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(table(spark, sf_dir, "documents"))
    return scored.withColumn("log_score", F.round("log_score", 4))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_collocations(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_html_extraction": op3_html_extraction,
        "op4_packing": op4_packing,
        "op5_token_counts": op5_token_counts,
        "op6_decontamination": op6_decontamination,
        "op7_lm_scoring": op7_lm_scoring,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_quality_rules": op9_quality_rules,
        "op10_near_dedup": op10_near_dedup,
        "op11_simhash_dedup": op11_simhash_dedup,
        "op12_collocations": op12_collocations,
        "op13_lexical_search": op13_lexical_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_lm_scoring": _OP7,
        "op6_decontamination": _OP6,
        "op8_substring_dedup": _OP8,
        "op10_near_dedup": _OP10,
        "op12_collocations": _OP12,
        "op13_lexical_search": _OP13,
    }


_OP6 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
l AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM l)),
dw AS (
  SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i
        FROM d, (SELECT DISTINCT n FROM l) WHERE len(w) >= n)),
h AS (SELECT dw.rid, dw.n, dw.i, bw.item_id FROM dw JOIN bw USING (n, g)),
hit AS (
  SELECT rid, count(DISTINCT p) AS n_hit
  FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT rid, n, i FROM h)) GROUP BY rid),
it AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)
"""

_OP8 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
g AS (
  SELECT rid, doc_id, i, md5(array_to_string(w[i : i + 12], ' ')) AS h
  FROM (SELECT rid, doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i
        FROM d WHERE len(w) >= 13 AND doc_id IS NOT NULL)),
m AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h),
x AS (
  SELECT DISTINCT rid, unnest(generate_series(i, i + 12)) AS p FROM g JOIN m USING (h) WHERE m.first < g.doc_id),
r AS (SELECT rid, list(p) AS gone FROM x GROUP BY rid),
k AS (
  SELECT doc_id, len(w) AS n, CASE WHEN gone IS NULL THEN w ELSE
         list_transform(list_filter(generate_series(1, len(w)), lambda p: NOT list_contains(gone, p)), lambda p: w[p]) END AS kept
  FROM d LEFT JOIN r USING (rid))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n - len(kept) AS BIGINT) AS n_removed,
       sha256(array_to_string(kept, ' ')) AS kept_sha256
FROM k
"""

_OP10 = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT rid, g FROM (
    SELECT rid, w[i] || ' ' || w[i + 1] AS g FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 2)
    UNION ALL SELECT rid, w[1] FROM d WHERE len(w) = 1)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY ALL),
e AS MATERIALIZED (
  SELECT a, b FROM p JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
r AS (SELECT rid, rid AS other FROM d UNION SELECT r.rid, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT r.rid, min(d.doc_id) AS component_id FROM r JOIN d ON d.rid = r.other GROUP BY r.rid)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d JOIN c USING (rid) LEFT JOIN n USING (rid)
"""

_OP7 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w
  FROM documents),
t AS (
  SELECT rid, i, w[i] AS word, CASE WHEN i > 1 THEN w[i - 1] END AS w1, CASE WHEN i > 2 THEN w[i - 2] END AS w2
  FROM (SELECT rid, w, unnest(generate_series(1, len(w))) AS i FROM d WHERE len(w) > 0)),
u AS (SELECT word, count(*) AS c FROM t GROUP BY word),
b AS (SELECT w1, word, count(*) AS c FROM t WHERE w1 IS NOT NULL GROUP BY ALL),
g AS (SELECT w2, w1, word, count(*) AS c FROM t WHERE w2 IS NOT NULL GROUP BY ALL),
s AS (
  SELECT t.rid, CASE WHEN g.c >= 2 THEN 0 WHEN b.c >= 2 THEN CAST(t.w2 IS NOT NULL AS INTEGER)
                     ELSE CAST(t.w2 IS NOT NULL AS INTEGER) + CAST(t.w1 IS NOT NULL AS INTEGER) END AS passed,
         CASE WHEN g.c >= 2 THEN ln(g.c / bb.c) WHEN b.c >= 2 THEN ln(b.c / uu.c) ELSE ln(u.c / (SELECT count(*) FROM t)) END AS seen
  FROM t JOIN u ON u.word = t.word LEFT JOIN u uu ON uu.word = t.w1 LEFT JOIN b ON b.w1 = t.w1 AND b.word = t.word
  LEFT JOIN b bb ON bb.w1 = t.w2 AND bb.word = t.w1 LEFT JOIN g ON g.w2 = t.w2 AND g.w1 = t.w1 AND g.word = t.word),
a AS (SELECT rid, sum(passed) AS passed, sum(seen + passed * ln(0.4)) AS score FROM s GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(passed, 0) AS BIGINT) AS n_backoffs,
       round(coalesce(score, 0.0), 4) AS log_score
FROM d LEFT JOIN a USING (rid)
"""

_OP13 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS docs, CAST(sum(len(w)) AS BIGINT) AS length FROM d),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
t AS (
  SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
k AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS weight
  FROM (SELECT term, count(*) AS df FROM t GROUP BY term), s),
c AS (
  SELECT item_id, rid, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(w) * docs) // length)))) AS BIGINT) AS score
  FROM q JOIN k USING (term) JOIN t USING (term) JOIN d USING (rid), s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM c WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
"""

_OP12 = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i
        FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a FROM f WHERE m >= 2 AND f >= 100),
k AS (
  SELECT lang, m, phrase, a, k, array_to_string(string_split(phrase, ' ')[1 : k], ' ') AS x,
         array_to_string(string_split(phrase, ' ')[k + 1 : m], ' ') AS y
  FROM (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM c)),
s AS (
  SELECT k.lang, k.m, k.phrase, k.a, k.k, l.f AS l, r.f AS r, n,
         CAST((CAST(1000 AS HUGEINT) * k.a * n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.m = k.k AND l.phrase = k.x
  JOIN f r ON r.lang = k.lang AND r.m = k.m - k.k AND r.phrase = k.y JOIN n ON n.lang = k.lang),
u AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (
  SELECT * FROM u WHERE NOT EXISTS (
    SELECT 1 FROM c WHERE c.lang = u.lang AND c.m > u.m AND 100 * c.a >= 100 * u.a
      AND contains(' ' || c.phrase || ' ', ' ' || u.phrase || ' '))),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, rank, phrase, a, l, r, n, score FROM t WHERE rank <= 2000
"""
