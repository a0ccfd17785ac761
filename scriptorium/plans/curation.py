"""Building a corpus: integration, de-duplication, sampling, balancing, splitting, auditing."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import maths
from scriptorium.functions.classes import CJK, SPACE
from scriptorium.functions.text import SPECIAL, language, special_ratio
from scriptorium.operators import audit, integration, planning, sampling
from scriptorium.plans.formats import sql_trim
from scriptorium.plans.registry import CORPUS, corpus, query, quoted
from scriptorium.sources.readers import table

INF = float("inf")
EQUAL_EDGES = [0.0, 200.0, 500.0, 1000.0, 2000.0, INF]
WEIGHTED_EDGES = [0.0, 500.0, 1000.0, 1500.0, 2000.0, 2500.0, 10000.0]
WEIGHTS = [0.1, 0.25, 0.3, 0.25, 0.08, 0.02]
AUDIT_EDGES = [0.0, 300.0, 600.0, 1000.0, 1500.0, 2000.0, 3000.0, 10000.0]


def sql_bin(x: str, edges: list[float], lowest: bool = False) -> str:
    out = "CASE"
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        upper = "" if b == INF else f" AND {x} <= {int(b)}"
        out += f" WHEN {x} {'>=' if lowest and i == 0 else '>'} {int(a)}{upper} THEN {i}"
    return out + " END"


def sql_label(x: str, edges: list[float]) -> str:
    return "CASE " + x + "".join(f" WHEN {i} THEN '{int(a)}-{'inf' if b == INF else int(b)}'" for i, (a, b) in enumerate(zip(edges, edges[1:]))) + " END"


def sql_rank(id: str, strata: str = "", seed: str = "42") -> str:
    return f"row_number() OVER ({'PARTITION BY ' + strata if strata else ''} ORDER BY md5('{seed}|' || CAST({id} AS VARCHAR)), {id})"


_STD = """std AS (SELECT -doc_id AS id, text, coalesce(label, 0) AS label, coalesce(source, 'unknown') AS source, length(text)::INT AS length, md5(text) AS text_hash, 0 AS priority FROM documents
UNION ALL SELECT row_id, text, coalesce(label, 0), coalesce(source, 'unknown'), length(text)::INT, md5(text), 1 FROM full_dataset
UNION ALL SELECT row_id, text_content, 0, 'unknown', length(text_content)::INT, md5(text_content), 2 FROM parallel_dataset)"""
_GOOD = f"good AS (SELECT * FROM std WHERE length BETWEEN 50 AND 5000 AND regexp_matches(text, {quoted(f'[^{SPACE}]')}))"
_FIRST = "kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text_hash ORDER BY priority, id) AS rn FROM good) WHERE rn = 1)"


def _std(spark, d):
    """All sources in one schema; ids of documents are negative, so that no two rows share an id and ranks have no ties."""
    frames = [integration.standardized(table(spark, d, "documents").withColumn("doc_id", -F.col("doc_id")), "doc_id", 0), integration.standardized(table(spark, d, "full_dataset"), "row_id", 1), integration.standardized(table(spark, d, "parallel_dataset").withColumnRenamed("text_content", "text"), "row_id", 2), integration.standardized(table(spark, d, "labels"), "doc_id", 3)]
    return integration.union(frames)


@query(f"WITH {_STD} SELECT * FROM std")
def standardize(spark, d):
    return _std(spark, d)


@query(f"WITH {_STD} SELECT source, count(*) AS n, count(text) AS n_texts FROM std GROUP BY source")
def union_by_name(spark, d):
    return _std(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.count("text").alias("n_texts"))


@query(f"WITH {_STD}, {_GOOD} SELECT id, source, label, length FROM good")
def quality_filter(spark, d):
    return integration.good(_std(spark, d)).select("id", "source", "label", "length")


@query("SELECT row_id, source, text_hash FROM (SELECT row_id, source, md5(text) AS text_hash, row_number() OVER (PARTITION BY md5(text) ORDER BY row_id) AS rn FROM full_dataset WHERE text IS NOT NULL) WHERE rn = 1")
def dedup_exact(spark, d):
    rows = table(spark, d, "full_dataset").filter("text is not null").select("row_id", "source", F.md5("text").alias("text_hash"))
    return integration.first_by_hash(rows, ["row_id"])


@query("SELECT count(text) AS n_texts, count(DISTINCT text) AS n_distinct, count(text) - count(DISTINCT text) AS n_duplicates, round(coalesce((count(text) - count(DISTINCT text))::DOUBLE / nullif(count(text), 0), 0), 6) AS duplicate_rate FROM full_dataset")
def dup_rate(spark, d):
    return integration.duplicate_stats(table(spark, d, "full_dataset"))


@query("SELECT row_id, substr(md5(text), 1, 12) AS content_id, md5(text) IS NOT DISTINCT FROM text_hash AS hash_ok FROM full_dataset")
def content_ids(spark, d):
    return table(spark, d, "full_dataset").select("row_id", F.substring(F.md5("text"), 1, 12).alias("content_id"), F.md5("text").eqNullSafe(F.col("text_hash")).alias("hash_ok"))


@query("SELECT text_id, row_id, source_model, generated_at FROM (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY loaded_at DESC, row_id DESC) AS rn FROM parallel_dataset) WHERE rn = 1")
def latest_delivery(spark, d):
    return integration.latest(table(spark, d, "parallel_dataset").select("text_id", "row_id", "source_model", "generated_at", "loaded_at"), "text_id", ["loaded_at", "row_id"]).drop("loaded_at")


_INTEGRATED = f"""WITH {_STD}, {_GOOD}, {_FIRST}, binned AS (SELECT *, {sql_bin('length', EQUAL_EDGES)} AS bin FROM kept),
r AS (SELECT *, {sql_rank('id', 'label, bin')} AS rank FROM binned), bal AS (SELECT * FROM r WHERE rank <= 2000),
s AS (SELECT *, {sql_rank('id', 'label', '42')} AS rk, count(*) OVER (PARTITION BY label) AS n FROM bal),
fin AS (SELECT id, source, label, length, CASE WHEN rk <= ceil(round(ceil(round(n * 0.3::DOUBLE, 9)) * 0.5::DOUBLE, 9)) THEN 'test' WHEN rk <= ceil(round(n * 0.3::DOUBLE, 9)) THEN 'val' ELSE 'train' END AS split FROM s)"""


def _integrated(spark, d):
    """Load, standardize, filter, de-duplicate, balance by length, split: one lazy plan, the filter below the aggregation."""
    kept = integration.first_by_hash(integration.good(_std(spark, d)).drop("text"), ["priority", "id"])
    binned = kept.withColumn("bin", maths.bin_of(F.col("length"), EQUAL_EDGES))
    even = sampling.equal_strata(binned, "id", "label", "bin", 20_000, 5)
    return sampling.split(even, "id", ["label"], 0.3, 0.5).select("id", "source", "label", "length", "split")


@query(_INTEGRATED + " SELECT * FROM fin")
def integrate(spark, d):
    return _integrated(spark, d)


@query(_INTEGRATED + " SELECT split, label, count(*) AS n, round(avg(length), 6) AS mean_length FROM fin GROUP BY ROLLUP (split, label)")
def dataset_stats(spark, d):
    return _integrated(spark, d).rollup("split", "label").agg(F.count("*").alias("n"), F.round(F.avg("length"), 6).alias("mean_length"))


@query(f"WITH {CORPUS} SELECT id, label FROM (SELECT *, {sql_rank('id')} AS rk FROM corpus) WHERE rk <= 300")
def sample_n(spark, d):
    return sampling.sample_n(corpus(spark, d).select("id", "label"), "id", 300)


@query(f"WITH {CORPUS} SELECT id, md5('42|' || CAST(id AS VARCHAR)) AS h FROM corpus")
def shuffle(spark, d):
    return sampling.shuffled(corpus(spark, d).select("id"), "id").withColumn("h", sampling.hash_key("id"))


@query(f"WITH {CORPUS}, b AS (SELECT id, label, {sql_bin('length(text)', EQUAL_EDGES)} AS bin FROM corpus) SELECT id, label, bin FROM (SELECT *, {sql_rank('id', 'label, bin')} AS rk FROM b WHERE bin IS NOT NULL) WHERE rk <= 40")
def strat_equal(spark, d):
    rows = corpus(spark, d).select("id", "label", maths.bin_of(F.length("text"), EQUAL_EDGES).alias("bin"))
    return sampling.equal_strata(rows, "id", "label", "bin", 400, 5)


_CAP = "CASE bin" + "".join(f" WHEN {i} THEN floor(target * {w}::DOUBLE)" for i, w in enumerate(WEIGHTS)) + " ELSE 0 END"


@query(f"""WITH l AS (SELECT row_id AS id, label, length(text)::INT AS length, {sql_bin('length(text)', WEIGHTED_EDGES)} AS bin FROM full_dataset WHERE text IS NOT NULL AND label IS NOT NULL),
m AS (SELECT min(n) AS target FROM (SELECT count(*) AS n FROM l GROUP BY label)),
r AS (SELECT *, {sql_rank('id', 'label, bin')} AS rk FROM l, m), t AS (SELECT *, coalesce(rk <= {_CAP}, false) AS taken FROM r),
p AS (SELECT *, {sql_rank('id', 'label, taken, (NOT taken AND length BETWEEN 800 AND 1800)', '42-refill')} AS again, count(*) FILTER (taken) OVER (PARTITION BY label) AS n FROM t)
SELECT id, label, length FROM p WHERE taken OR (length BETWEEN 800 AND 1800 AND again <= target - n)""")
def strat_weighted(spark, d):
    rows = table(spark, d, "full_dataset").filter("text is not null and label is not null").select(F.col("row_id").alias("id"), "label", F.length("text").alias("length"))
    least = rows.groupBy("label").agg(F.count("*").alias("n")).agg(F.min("n").alias("target"))  # one row
    return sampling.weighted_strata(rows.crossJoin(F.broadcast(least)), "id", "length", WEIGHTED_EDGES, WEIGHTS, F.col("target"), ["label"]).drop("target")


@query(f"""WITH c AS (SELECT row_id AS id, label, CASE WHEN label = 1 AND length(text) > 2500 THEN 2500 ELSE length(text) END::INT AS length FROM full_dataset WHERE text IS NOT NULL AND label IS NOT NULL),
f AS (SELECT * FROM c WHERE label = 1 OR length >= 300), r AS (SELECT *, {sql_rank('id', 'label')} AS rk FROM f), m AS (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM f GROUP BY label))
SELECT id, label, length FROM r, m WHERE rk <= least""")
def class_balance(spark, d):
    rows = table(spark, d, "full_dataset").filter("text is not null and label is not null").select(F.col("row_id").alias("id"), "label", "text")
    cut = integration.truncated(rows).select("id", "label", "length").filter("label = 1 or length >= 300")
    return sampling.balanced(cut, "id", "label")


def _sql_split(held: str, test: str) -> str:
    return f"CASE WHEN rk <= ceil(round(ceil(round(n * {held}::DOUBLE, 9)) * {test}::DOUBLE, 9)) THEN 'test' WHEN rk <= ceil(round(n * {held}::DOUBLE, 9)) THEN 'val' ELSE 'train' END"


@query(f"WITH {CORPUS}, r AS (SELECT id, label, {sql_rank('id', 'label')} AS rk, count(*) OVER (PARTITION BY label) AS n FROM corpus) SELECT id, label, {_sql_split('0.3', '0.5')} AS split FROM r")
def split_stratified(spark, d):
    return sampling.split(corpus(spark, d).select("id", "label"), "id", ["label"], 0.3, 0.5)


@query(f"WITH {CORPUS}, r AS (SELECT id, label, {sql_rank('id', 'label')} AS rk, count(*) OVER (PARTITION BY label) AS n FROM corpus) SELECT id, label, {_sql_split('0.2', '0.5')} AS split FROM r")
def split_80_10_10(spark, d):
    return sampling.split(corpus(spark, d).select("id", "label"), "id", ["label"], 0.2, 0.5)


@query(f"WITH {CORPUS}, r AS (SELECT id, {sql_rank('id')} AS rk, count(*) OVER () AS n FROM corpus) SELECT id, {_sql_split('0.2', '0.5')} AS split FROM r")
def split_unstratified(spark, d):
    return sampling.split(corpus(spark, d).select("id"), "id", [], 0.2, 0.5)


@query(f"WITH {CORPUS}, r AS (SELECT id, label, category, {sql_rank('id', 'label')} AS rk, count(*) OVER (PARTITION BY label) AS n FROM corpus), s AS (SELECT *, {_sql_split('0.2', '0.5')} AS split FROM r) SELECT id, label, category FROM s WHERE split = 'test' AND category IN ('C2', 'C3', 'C4', 'Human')")
def category_holdout(spark, d):
    parts = sampling.split(corpus(spark, d).select("id", "label", "category"), "id", ["label"], 0.2, 0.5)
    return parts.filter("split = 'test'").filter(F.col("category").isin("C2", "C3", "C4", "Human")).drop("split")


@query("""WITH p AS (SELECT 'train' AS part, text FROM train UNION ALL SELECT 'val', text FROM val UNION ALL SELECT 'test', text FROM test),
c AS (SELECT text, count(*) FILTER (part = 'train') AS a, count(*) FILTER (part = 'val') AS b, count(*) FILTER (part = 'test') AS c FROM p WHERE text IS NOT NULL GROUP BY text)
SELECT 'train' AS part_a, 'val' AS part_b, count(*) FILTER (a > 0 AND b > 0) AS shared_texts, coalesce(sum(b) FILTER (a > 0), 0)::BIGINT AS leaked_rows FROM c
UNION ALL SELECT 'train', 'test', count(*) FILTER (a > 0 AND c > 0), coalesce(sum(c) FILTER (a > 0), 0)::BIGINT FROM c UNION ALL SELECT 'val', 'test', count(*) FILTER (b > 0 AND c > 0), coalesce(sum(c) FILTER (b > 0), 0)::BIGINT FROM c""")
def split_leakage(spark, d):
    return integration.leakage({n: table(spark, d, n).select("text") for n in ("train", "val", "test")})


@query("""WITH t AS (SELECT category, contains(text, '[SEP]') AS marked, label FROM train WHERE text IS NOT NULL) SELECT category, count(*) AS n, count(*) FILTER (marked) AS n_marked, round(avg(CAST(marked AS INT)), 6) AS marker_rate, round(avg(label) FILTER (marked), 6) AS label_rate_marked FROM t GROUP BY category""")
def marker_leak_rate(spark, d):
    t = table(spark, d, "train").filter("text is not null").withColumn("marked", F.col("text").contains("[SEP]"))
    return t.groupBy("category").agg(F.count("*").alias("n"), F.count_if("marked").alias("n_marked"), F.round(F.avg(F.col("marked").cast("int")), 6).alias("marker_rate"), F.round(F.avg(F.when(F.col("marked"), F.col("label"))), 6).alias("label_rate_marked"))


@query("""SELECT doc_id, category, place FROM (SELECT doc_id, category, row_number() OVER (PARTITION BY category ORDER BY collected_at, doc_id)::INT AS place FROM documents) WHERE (category = 'C2' AND place <= 1000) OR (category = 'C3' AND place <= 1000) OR (category = 'C4' AND place <= 500)""")
def quota_fill(spark, d):
    return sampling.quota(table(spark, d, "documents").select("doc_id", "category", "collected_at"), "category", ["collected_at", "doc_id"], {"C2": 1000, "C3": 1000, "C4": 500}).select("doc_id", "category", "place")


@query("""WITH b AS (SELECT text, arg_max(boundary, doc_id) FILTER (boundary IS NOT NULL) AS boundary FROM documents WHERE text IS NOT NULL GROUP BY text)
SELECT f.row_id, b.boundary AS boundary FROM (SELECT row_id, text FROM train UNION ALL SELECT -doc_id, text FROM documents WHERE category = 'C2') f LEFT JOIN b ON f.text = b.text""")
def text_lookup_join(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "category", "boundary")
    probe = table(spark, d, "train").select("row_id", "text").unionByName(docs.filter("category = 'C2'").select((-F.col("doc_id")).alias("row_id"), "text"))
    known = docs.filter("boundary is not null").withColumnRenamed("boundary", "b")
    return integration.looked_up(probe, known, "text", "b", "doc_id", "boundary").select("row_id", "boundary")


@query(f"WITH {CORPUS} SELECT id, label FROM (SELECT *, {sql_rank('id')} AS rk FROM corpus) WHERE rk > 300")
def anti_join_remaining(spark, d):
    rows = corpus(spark, d).select("id", "label")
    return integration.remaining(rows, sampling.sample_n(rows, "id", 300), "id")


@query("SELECT g.plan_id, p.plan_id IS NOT NULL OR coalesce(g.generated_parallel, false) AS generated_parallel FROM generation_plan g LEFT JOIN (SELECT DISTINCT CAST(substr(text_id, 10) AS BIGINT) AS plan_id FROM parallel_dataset) p ON g.plan_id = p.plan_id")
def completed_update(spark, d):
    done = table(spark, d, "parallel_dataset").select(F.substring("text_id", 10, 20).cast("bigint").alias("plan_id"))
    return integration.flagged(table(spark, d, "generation_plan").select("plan_id", "generated_parallel"), done, "plan_id", "generated_parallel")


@query("SELECT p.row_id, p.text_id, g.plan_id IS NOT NULL AS matched, g.plan_id, g.topic_domain, g.model_family, p.source_model FROM parallel_dataset p LEFT JOIN generation_plan g ON CAST(substr(p.text_id, 10) AS BIGINT) = g.plan_id")
def merge_by_name(spark, d):
    rows = table(spark, d, "parallel_dataset").select("row_id", "text_id", "source_model", F.concat(F.lit("parallel_"), F.substring("text_id", 10, 20).cast("bigint")).alias("name"))
    plan = table(spark, d, "generation_plan").select(F.concat(F.lit("parallel_"), F.col("plan_id")).alias("name"), "plan_id", "topic_domain", "model_family")
    return integration.merged(rows, plan, "name").select("row_id", "text_id", "matched", "plan_id", "topic_domain", "model_family", "source_model")


@query(f"""WITH {CORPUS} SELECT source, count(*) AS count, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS median, round(stddev_samp(n), 6) AS std, min(n) AS min, max(n) AS max, round(quantile_cont(n, 0.25), 6) AS q25, round(quantile_cont(n, 0.75), 6) AS q75
FROM (SELECT source, length(text)::DOUBLE AS n FROM corpus) GROUP BY source""")
def length_distribution(spark, d):
    return audit.length_distribution(corpus(spark, d), "source", F.length("text"))


@query(f"""WITH b AS (SELECT {sql_bin('length(text)', AUDIT_EDGES)} AS bin, label FROM full_dataset), c AS (SELECT bin, count(*) FILTER (label = 1) AS n_ai, count(*) FILTER (label = 0) AS n_human FROM b WHERE bin IS NOT NULL AND label IS NOT NULL GROUP BY bin)
SELECT bin, {sql_label('bin', AUDIT_EDGES)} AS range, n_ai, n_human, round(n_human::DOUBLE / nullif(n_ai, 0), 6) AS ratio, CASE WHEN n_ai = 0 THEN 'no_ai' WHEN n_human = 0 THEN 'no_human' WHEN n_human::DOUBLE / n_ai BETWEEN 0.8 AND 1.2 THEN 'balanced' ELSE 'unbalanced' END AS status FROM c""")
def length_bins_audit(spark, d):
    return audit.length_balance(table(spark, d, "full_dataset"), AUDIT_EDGES)


@query("""WITH a AS (SELECT avg(CASE WHEN label = 1 THEN CAST(length(text) < 300 AS INT) END) AS short_before, avg(length(text)) FILTER (label = 1) AS ai, avg(length(text)) FILTER (label = 0) AS human FROM full_dataset WHERE text IS NOT NULL),
b AS (SELECT avg(CASE WHEN label = 1 THEN CAST(length(text) < 300 AS INT) END) AS short_after, avg(length(text)) FILTER (label = 1) AS ai, avg(length(text)) FILTER (label = 0) AS human FROM full_dataset_length_balanced WHERE text IS NOT NULL)
SELECT round(short_before, 6) AS short_ai_before, round(short_after, 6) AS short_ai_after, round(abs(a.ai - a.human), 6) AS gap_before, round(abs(b.ai - b.human), 6) AS gap_after, round((abs(a.ai - a.human) - abs(b.ai - b.human)) / nullif(abs(a.ai - a.human), 0) * 100, 6) AS improvement_percent FROM a, b""")
def short_share(spark, d):
    def stats(name):
        n = F.length("text")
        ai = F.col("label") == 1
        return table(spark, d, name).filter("text is not null").agg(F.avg(F.when(ai, (n < 300).cast("int"))).alias("s"), F.abs(F.avg(F.when(ai, n)) - F.avg(F.when(F.col("label") == 0, n))).alias("g"))

    a, b = stats("full_dataset").toDF("s0", "g0"), stats("full_dataset_length_balanced").toDF("s1", "g1")
    return a.crossJoin(F.broadcast(b)).select(F.round("s0", 6).alias("short_ai_before"), F.round("s1", 6).alias("short_ai_after"), F.round("g0", 6).alias("gap_before"), F.round("g1", 6).alias("gap_after"), F.round(F.try_divide(F.col("g0") - F.col("g1"), F.col("g0")) * 100, 6).alias("improvement_percent"))  # one row each


@query("SELECT label, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM documents WHERE label IS NOT NULL GROUP BY label")
def label_balance(spark, d):
    return integration.within_shares(table(spark, d, "documents").filter("label is not null"), "label")


@query("SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source")
def value_counts(spark, d):
    return table(spark, d, "documents").filter("source is not null").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")


@query("SELECT label, round(avg(length(text)), 6) AS mean_length, round(quantile_cont(length(text), 0.5), 6) AS median_length FROM full_dataset WHERE text IS NOT NULL GROUP BY label")
def class_lengths(spark, d):
    n = F.length("text")
    return table(spark, d, "full_dataset").filter("text is not null").groupBy("label").agg(F.round(F.avg(n), 6).alias("mean_length"), F.round(F.median(n), 6).alias("median_length"))


@query("SELECT count(*) AS n_rows, count(*) - count(text) AS text_missing, count(*) - count(label) AS label_missing, count(*) - count(source) AS source_missing, round((count(*) - count(text))::DOUBLE / nullif(count(*), 0), 6) AS text_missing_rate FROM full_dataset")
def missing_rates(spark, d):
    none = lambda c: F.count_if(F.col(c).isNull())
    return table(spark, d, "full_dataset").agg(F.count("*").alias("n_rows"), none("text").alias("text_missing"), none("label").alias("label_missing"), none("source").alias("source_missing"), F.round(F.try_divide(none("text").cast("double"), F.count("*").cast("double")), 6).alias("text_missing_rate"))


SQL_LANGUAGE = f"CASE WHEN text IS NULL THEN 'unknown' WHEN length({sql_trim('text')}) = 0 THEN 'empty' WHEN len(regexp_extract_all(text, '[{CJK}]')) / length({sql_trim('text')})::DOUBLE > 0.5 THEN 'chinese' WHEN len(regexp_extract_all(text, '[{CJK}]')) / length({sql_trim('text')})::DOUBLE > 0.1 THEN 'mixed' ELSE 'non_chinese' END"
SQL_SPECIAL = f"coalesce(len(regexp_extract_all(text, {quoted(SPECIAL)})) / greatest(length(text), 1)::DOUBLE, 1.0)"


@query(f"SELECT lang, {SQL_LANGUAGE} AS detected, count(*) AS n FROM documents GROUP BY ALL")
def language_mix(spark, d):
    return table(spark, d, "documents").groupBy("lang", language(F.col("text")).alias("detected")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, round({SQL_SPECIAL}, 6) AS special_ratio FROM documents")
def special_ratio_(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(special_ratio(F.col("text")), 6).alias("special_ratio"))


_QUALITY = f"""a AS (SELECT text, label, length(text)::DOUBLE AS n, {SQL_SPECIAL} AS special, {SQL_LANGUAGE} AS lang FROM SRC),
o AS (SELECT count(*) AS n_rows, (count(*) - count(text))::DOUBLE / nullif(count(*), 0) AS missing, (count(*) - count(label))::DOUBLE / nullif(count(*), 0) AS label_missing, (count(text) - count(DISTINCT text))::DOUBLE / nullif(count(*), 0) AS dup, avg(n) AS mean_length,
 count(*) FILTER (special > 0.1)::DOUBLE / nullif(count(*), 0) AS hs, avg(special) AS special, count(*) FILTER (lang = 'chinese')::DOUBLE / nullif(count(*), 0) AS zh, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM a),
b AS (SELECT *, CASE WHEN n0 = 0 OR n1 = 0 THEN 1.0 ELSE least(n0, n1)::DOUBLE / greatest(n0, n1) END::DOUBLE AS balance FROM o),
s AS (SELECT *, greatest(0, least(100, 100 - 30 * missing - 25 * dup + 20 * (balance - 0.5) - 15 * hs + CASE WHEN zh > 0.8 THEN 10 * (zh - 0.8) ELSE 0 END - CASE WHEN mean_length < 50 OR mean_length > 2000 THEN 10 ELSE 0 END)) AS score FROM b)"""


def _sql_quality(src: str) -> str:
    return f"WITH {_QUALITY.replace('SRC', src)} SELECT n_rows, round(missing, 6) AS text_missing_rate, round(label_missing, 6) AS label_missing_rate, round(dup, 6) AS duplicate_rate, round(balance, 6) AS balance_ratio, round(hs, 6) AS high_special_rate, round(special, 6) AS mean_special_ratio, round(zh, 6) AS chinese_rate, round(mean_length, 6) AS mean_length, round(score, 6) AS score, CASE WHEN score >= 80 THEN 'high' WHEN score >= 60 THEN 'medium' ELSE 'low' END AS level FROM s"


@query(_sql_quality("full_dataset"))
def quality_report(spark, d):
    return audit.quality(table(spark, d, "full_dataset"))


_TABLES = ("documents", "full_dataset", "full_dataset_length_balanced", "train", "val", "test")


@query("SELECT level, count(*) AS n, round(avg(score), 6) AS mean_score FROM (" + " UNION ALL ".join(f"SELECT level, score FROM ({_sql_quality(t)})" for t in _TABLES) + ") GROUP BY level")
def quality_rollup(spark, d):
    each = integration.union([audit.quality(table(spark, d, t)).select("level", "score") for t in _TABLES])
    return each.groupBy("level").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


@query("SELECT count(DISTINCT source)::INT AS n_sources, CASE WHEN bool_or(source = 'generated_human_style') THEN 'rejected' WHEN bool_or(source = 'human_texts') THEN 'warning' WHEN bool_or(source = 'news_real') THEN 'ok' ELSE 'unknown' END AS verdict FROM full_dataset WHERE label = 0")
def human_sources(spark, d):
    return integration.verdict_of_sources(table(spark, d, "full_dataset").filter("label = 0"), "generated_human_style", "human_texts", "news_real")


@query("SELECT DISTINCT source, label FROM full_dataset")
def distinct_values(spark, d):
    return table(spark, d, "full_dataset").select("source", "label").distinct()


_REBUILT = f"""WITH h AS (SELECT row_id AS id, text, label, source, CAST(NULL AS VARCHAR) AS category FROM full_dataset WHERE text IS NOT NULL UNION ALL SELECT -doc_id, text, label, source, category FROM documents WHERE text IS NOT NULL AND category IN ('C2', 'C3', 'C4')
UNION ALL SELECT row_id + 1000000000000, text, label, source, 'Human' FROM (SELECT *, {sql_rank('row_id')} AS rk FROM full_dataset WHERE label = 0 AND text IS NOT NULL) WHERE rk <= 3000),
r AS (SELECT id, label, category, {sql_rank('id', 'label')} AS rk, count(*) OVER (PARTITION BY label) AS n FROM h), s AS (SELECT id, label, category, {_sql_split('0.2', '0.5')} AS split FROM r)"""


@query(_REBUILT + " SELECT id, label, category, split FROM s")
def hybrid_rebuild(spark, d):
    full = table(spark, d, "full_dataset").filter("text is not null").select(F.col("row_id").alias("id"), "label", F.lit(None).cast("string").alias("category"))
    mixed = table(spark, d, "documents").filter("text is not null and category in ('C2', 'C3', 'C4')").select((-F.col("doc_id")).alias("id"), "label", "category")
    controls = sampling.sample_n(full.filter("label = 0"), "id", 3000).select((F.col("id") + 1000000000000).alias("id"), "label", F.lit("Human").alias("category"))
    return sampling.split(integration.union([full, mixed, controls]), "id", ["label"], 0.2, 0.5)


@query(_REBUILT + " SELECT id, label, category FROM s WHERE split = 'test' AND category IS NOT NULL")
def hybrid_test(spark, d):
    return hybrid_rebuild(spark, d).filter("split = 'test' and category is not null").drop("split")


@query("""WITH t AS (SELECT topic, count(*) AS n FROM generation_plan GROUP BY topic), a AS (SELECT count(*) FILTER (topic IS NOT NULL) AS topics, max(n) FILTER (topic IS NOT NULL) AS top, sum(n) AS total FROM t),
u AS (SELECT count(DISTINCT topic) AS used FROM parallel_dataset WHERE topic IN (SELECT topic FROM generation_plan)), p AS (SELECT (count(text_content) - count(DISTINCT text_content))::DOUBLE / count(text_content) AS dup FROM parallel_dataset)
SELECT round(used::DOUBLE / topics, 6) AS topic_coverage, round(top::DOUBLE / total, 6) AS top_topic_share, round(dup, 6) AS duplicate_rate, used::DOUBLE / topics >= 0.95 AS coverage_ok, top::DOUBLE / total <= 0.025 AS share_ok, dup < 0.02 AS duplicates_ok FROM a, u, p""")
def coverage_guards(spark, d):
    plan, texts = table(spark, d, "generation_plan"), table(spark, d, "parallel_dataset")
    a = plan.groupBy("topic").agg(F.count("*").alias("n")).agg(F.count("topic").alias("topics"), F.max(F.when(F.col("topic").isNotNull(), F.col("n"))).alias("top"), F.sum("n").alias("total"))
    u = texts.join(plan.select("topic").distinct(), "topic", "left_semi").agg(F.count_distinct("topic").alias("used"))
    p = texts.agg(((F.count("text_content") - F.count_distinct("text_content")) / F.count("text_content")).alias("dup"))
    j = a.crossJoin(F.broadcast(u)).crossJoin(F.broadcast(p))  # one row each
    cover, share = F.col("used") / F.col("topics"), F.col("top") / F.col("total")
    return j.select(F.round(cover, 6).alias("topic_coverage"), F.round(share, 6).alias("top_topic_share"), F.round("dup", 6).alias("duplicate_rate"), (cover >= 0.95).alias("coverage_ok"), (share <= 0.025).alias("share_ok"), (F.col("dup") < 0.02).alias("duplicates_ok"))


def _sql_shares(shares: dict[str, float]) -> str:
    return "(SELECT unnest([" + ", ".join(f"{{'k': '{k}', 's': {v}::DOUBLE}}" for k, v in shares.items()) + "], recursive := true))"


@query(f"""WITH h AS (SELECT g.topic_domain, {sql_label(sql_bin('length(p.text_content)', list(planning.LENGTH_EDGES)), list(planning.LENGTH_EDGES))} AS length_range, p.attribute FROM parallel_dataset p JOIN generation_plan g ON CAST(substr(p.text_id, 10) AS BIGINT) = g.plan_id),
q AS (SELECT a.k AS topic_domain, b.k AS length_range, c.k AS attribute, a.s * b.s * c.s AS share FROM {_sql_shares(planning.DOMAIN_SHARES)} a, {_sql_shares(planning.LENGTH_SHARES)} b, {_sql_shares(planning.ATTRIBUTE_SHARES)} c),
t AS (SELECT topic_domain, length_range, attribute, round(share * (SELECT count(*) FROM h), 6) AS target FROM q), n AS (SELECT topic_domain, length_range, attribute, count(*) AS actual FROM h GROUP BY ALL)
SELECT t.topic_domain, t.length_range, t.attribute, target, coalesce(actual, 0) AS actual, round((coalesce(actual, 0) - target) / nullif(target, 0), 6) AS deviation, coalesce(abs((coalesce(actual, 0) - target) / nullif(target, 0)) <= 0.1, false) AS within
FROM t LEFT JOIN n ON t.topic_domain = n.topic_domain AND t.length_range = n.length_range AND t.attribute = n.attribute""")
def quota_matrix(spark, d):
    edges = list(planning.LENGTH_EDGES)
    texts = table(spark, d, "parallel_dataset").select("attribute", maths.bin_label(maths.bin_of(F.length("text_content"), edges), edges).alias("length_range"), F.substring("text_id", 10, 20).cast("bigint").alias("plan_id"))
    rows = texts.join(table(spark, d, "generation_plan").select("plan_id", "topic_domain"), "plan_id")
    names = ["topic_domain", "length_range", "attribute"]
    return planning.against(planning.quotas([planning.DOMAIN_SHARES, planning.LENGTH_SHARES, planning.ATTRIBUTE_SHARES], names, rows), rows, names)
