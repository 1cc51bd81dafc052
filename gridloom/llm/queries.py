"""The queries of this subpackage, each over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import fingerprint, langid, lm_scoring, mixing, near_dedup, neighbours, packing, quality, substring_dedup, url_filter
from gridloom.llm.scratch import Scratch

#: Target weights of the mix; `*` is what all other sources share.
WEIGHTS = {"src0": 10, **{f"src{i}": 4 + i % 4 for i in range(1, 20)}, "*": 3}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def captures(pages: DataFrame) -> DataFrame:
    """pages with a fetch day: page_id steps through 2024."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")).alias("fetched"))


def dated_list(pages: DataFrame) -> DataFrame:
    """Entries for hosts of the table, by the digits of their digests: added, removed, added again."""
    host = pages.select(url_filter.host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    seed = host.withColumn("a", F.ascii(F.substring(F.md5(F.col("host").cast("binary")), 1, 1))).withColumn("b", F.ascii(F.substring(F.md5(F.col("host").cast("binary")), 2, 1)))
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    blocked = seed.where("a % 3 = 0")
    parent = F.array_join(F.slice(F.split("host", "\\."), -3, 3), ".")
    rows = [
        blocked.select(F.col("host").alias("pattern"), F.lit("block").alias("kind"), F.lit("add").alias("action"), day(F.col("b")).alias("dated")),
        blocked.select("host", F.lit("block"), F.lit("remove"), day(F.col("b") + 90)),
        blocked.where("b % 2 = 0").select("host", F.lit("block"), F.lit("add"), day(F.col("b") + 180)),
        seed.where("a % 5 = 1 and size(split(host, '[.]')) > 3").select(parent, F.lit("block"), F.lit("add"), day(F.col("a"))),
        seed.where("b % 2 = 1").select(F.concat("host", F.lit("/en")), F.lit("allow"), F.lit("add"), day(F.col("b"))),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filter.filter_urls(captures(pages), dated_list(pages))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(_table(spark, sf_dir, "documents"), Scratch(spark, "op2"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", F.greatest(F.lit(1), F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("chars"))
    rows = mixing.schedule(docs, WEIGHTS, size=F.col("chars"))
    return rows.select("doc_id", *[F.col(c) for c in rows.columns if c.startswith("mix_")])


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, Scratch(spark, "op4"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_edits(_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(_table(spark, sf_dir, "documents"), Scratch(spark, "op6"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), Scratch(spark, "op8"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_lm_scoring, op3_mixing, op4_nearest, op5_fingerprints, op6_substring_dedup, op7_language_id, op8_near_dedup, op9_packing, op10_quality)}

_SQL1 = f"""
WITH cap AS (SELECT DISTINCT page_id, url, DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INT) AS fetched,
    lower(regexp_extract(url, '{url_filter.HOST}', 1)) AS host, list_filter(string_split(regexp_extract(url, '{url_filter.PATH}', 1), '/'), lambda x: x <> '') AS steps FROM pages),
seed AS (SELECT DISTINCT host, ascii(substr(md5(host), 1, 1)) AS a, ascii(substr(md5(host), 2, 1)) AS b, string_split(host, '.') AS labels FROM cap WHERE host <> ''),
entry(pattern, kind, action, dated) AS (
    SELECT host, 'block', 'add', DATE '2024-01-01' + b FROM seed WHERE a % 3 = 0
    UNION ALL SELECT host, 'block', 'remove', DATE '2024-01-01' + b + 90 FROM seed WHERE a % 3 = 0
    UNION ALL SELECT host, 'block', 'add', DATE '2024-01-01' + b + 180 FROM seed WHERE a % 3 = 0 AND b % 2 = 0
    UNION ALL SELECT array_to_string(labels[-3:], '.'), 'block', 'add', DATE '2024-01-01' + a FROM seed WHERE a % 5 = 1 AND len(labels) > 3
    UNION ALL SELECT host || '/en', 'allow', 'add', DATE '2024-01-01' + b FROM seed WHERE b % 2 = 1),
step AS (SELECT pattern, kind, dated, max(action) AS action FROM entry GROUP BY ALL),
span AS (SELECT *, lead(dated) OVER (PARTITION BY pattern, kind ORDER BY dated) AS until FROM step),
ask AS (
    SELECT page_id, url, fetched, array_to_string(string_split(host, '.')[i:], '.') AS pattern FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM cap WHERE host <> '')
    UNION SELECT page_id, url, fetched, host || '/' || array_to_string(steps[1:i], '/') FROM (SELECT *, unnest(range(1, len(steps) + 1)) AS i FROM cap WHERE host <> '')),
hit AS (SELECT ask.*, kind, dated, row_number() OVER (PARTITION BY page_id, url, fetched ORDER BY length(ask.pattern) DESC, kind = 'allow' DESC, ask.pattern DESC) AS nth
    FROM ask JOIN span ON ask.pattern = span.pattern AND action = 'add' AND dated <= fetched AND (until IS NULL OR fetched < until))
SELECT cap.page_id, cap.url, CAST(cap.fetched AS DATE) AS fetched, coalesce(kind, 'none') AS decision, pattern, CAST(dated AS DATE) AS valid_from
FROM cap LEFT JOIN hit ON nth = 1 AND cap.page_id = hit.page_id AND cap.url = hit.url AND cap.fetched = hit.fetched
"""


def _sql3() -> str:
    total = sum(WEIGHTS.values())
    slots = ", ".join(f"('{s}', {j}, {t})" for s, own in mixing.period(WEIGHTS).items() for j, t in enumerate(own))
    return f"""
WITH slot(s, j, t) AS (VALUES {slots}), weight AS (SELECT s, count(*) AS n FROM slot GROUP BY s),
sized AS (SELECT doc_id, CASE WHEN source IN (SELECT s FROM weight) THEN source ELSE '*' END AS s, greatest(1, coalesce(length(text), 0)) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY s ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM sized),
cut AS (SELECT doc_id, placed.s, CAST(start AS BIGINT) AS start, CAST(start AS BIGINT) // {mixing.BLOCK} AS block, n FROM placed JOIN weight ON placed.s = weight.s)
SELECT doc_id, cut.s AS mix_source, start AS mix_start, block AS mix_block, block * {total} // n AS mix_release, ((block + 1) * {total} + n - 1) // n AS mix_deadline, (block // n) * {total} + t AS mix_slot
FROM cut JOIN slot ON cut.s = slot.s AND j = block % n
"""


_SQL6 = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, i, hash(array_to_string(words[i:i + 49], ' ')) AS h FROM (SELECT *, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50)),
gone AS (SELECT DISTINCT win.doc_id, i FROM win JOIN (SELECT h, min(doc_id) AS lo FROM win GROUP BY h) f ON win.h = f.h AND win.doc_id > lo),
cover AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM gone),
lost AS (SELECT doc_id, list(p) AS ps FROM cover GROUP BY doc_id),
kept AS (SELECT w.doc_id, words, CASE WHEN ps IS NULL THEN words ELSE list_filter(words, lambda x, p: NOT list_contains(ps, p)) END AS k FROM w LEFT JOIN lost ON w.doc_id = lost.doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - len(k) AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""

ORACLE_SQL = {"op1_url_filters": _SQL1, "op3_mixing": _sql3(), "op6_substring_dedup": _SQL6}
