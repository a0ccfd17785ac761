"""Markup: stripping, detection, statistics, debiasing."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import markup
from scriptorium.functions.classes import EDGES, SPACE
from scriptorium.operators import audit, metrics
from scriptorium.plans.registry import CORPUS, corpus, multi, query, quoted


def sql_strip(x: str) -> str:
    for pattern, kept in markup.STRIP:
        x = f"regexp_replace({x}, {multi(pattern)}, {quoted(chr(92) + '1' if kept == '1' else kept)}, 'g')"
    return sql_trim(x)


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, {quoted(EDGES)}, '', 'g')"


def sql_any(x: str) -> str:
    return "coalesce(" + " OR ".join(f"regexp_matches({x}, {multi(p)})" for p in markup.ANY) + ", false)"


def sql_kind(x: str, kind: str) -> str:
    return f"coalesce(regexp_matches({x}, {multi(markup.KINDS[kind])}), false)"


def sql_kinds(x: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {sql_kind(x, k)} THEN '{k}' END" for k in markup.KINDS) + "], lambda k: k IS NOT NULL)"


def sql_safe(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0)"


SQL_CONFUSION = "count(*) FILTER (pred = 1 AND label = 1) AS tp, count(*) FILTER (pred = 1 AND label = 0) AS fp, count(*) FILTER (pred = 0 AND label = 0) AS tn, count(*) FILTER (pred = 0 AND label = 1) AS fn"
SQL_PRF = f"round({sql_safe('tp + tn', 'tp + fp + tn + fn')}, 6) AS accuracy, round({sql_safe('tp', 'tp + fp')}, 6) AS precision, round({sql_safe('tp', 'tp + fn')}, 6) AS recall, round({sql_safe('2 * tp', '2 * tp + fp + fn')}, 6) AS f1"


@query(f"""WITH {CORPUS}, m AS (SELECT CAST({sql_any('text')} AS INT) AS pred, label FROM corpus),
a AS (SELECT coalesce(avg(CAST(pred AS DOUBLE)) FILTER (label = 1), 0) AS ai, coalesce(avg(CAST(pred AS DOUBLE)) FILTER (label = 0), 0) AS human, {SQL_CONFUSION} FROM m)
SELECT round(ai, 6) AS ai_md_rate, round(human, 6) AS human_md_rate, round(abs(ai - human), 6) AS bias, {SQL_PRF}, tp, fp, tn, fn,
CASE WHEN abs(ai - human) < 0.05 THEN 'pass' WHEN abs(ai - human) < 0.15 THEN 'warning' ELSE 'fail' END AS status FROM a""")
def format_bias(spark, d):
    return audit.format_bias(corpus(spark, d))


@query(f"SELECT doc_id, {sql_strip('text')} AS stripped FROM documents")
def md_strip(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", markup.strip_markup(F.col("text")).alias("stripped"))


@query(f"SELECT row_id, {sql_strip(sql_strip(sql_strip('text')))} AS stripped FROM full_dataset")
def md_strip_fixpoint(spark, d):
    return spark.read.parquet(f"{d}/full_dataset.parquet").select("row_id", markup.strip_markup_fixpoint(F.col("text")).alias("stripped"))


@query(f"""SELECT doc_id, {sql_any('text')} AS has_md, {', '.join(f"{sql_kind('text', k)} AS has_{k}" for k in markup.KINDS)}, len({sql_kinds('text')})::INT AS n_kinds, round(len({sql_kinds('text')}) / 11.0::DOUBLE, 6) AS diversity FROM documents""")
def md_features(spark, d):
    t = F.col("text")
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("k", markup.kinds(t))
    return docs.select("doc_id", markup.has_markup(t).alias("has_md"), *[markup.has_kind(t, k).alias(f"has_{k}") for k in markup.KINDS], F.size("k").alias("n_kinds"), F.round(F.size("k") / 11.0, 6).alias("diversity"))


@query(f"""SELECT doc_id, {', '.join(f"coalesce(len(regexp_extract_all(text, {multi(p)})), 0)::INT AS n_{k}" for k, p in markup.COUNTED.items())},
coalesce(list_sort(list_distinct(list_transform(regexp_extract_all(text, {multi(f'^(#{{1,6}})[{SPACE}]')}, 1), lambda m: length(m)::INT))), []) AS levels FROM documents""")
def md_detail_counts(spark, d):
    t = F.col("text")
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", *[markup.count_kind(t, k).alias(f"n_{k}") for k in markup.COUNTED], markup.title_levels(t).alias("levels"))


@query(f"""WITH k AS (SELECT doc_id, {sql_kinds('text')} AS a, {sql_kinds(sql_strip('text'))} AS b FROM documents WHERE {sql_any('text')})
SELECT doc_id, list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS removed, list_sort(list_filter(b, lambda x: NOT list_contains(a, x))) AS added, list_sort(list_filter(a, lambda x: list_contains(b, x))) AS common,
(len(a) - len(b))::INT AS reduction, round((len(b) - len(a)) / 11.0::DOUBLE, 6) AS diversity_change FROM k""")
def md_compare(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").filter(markup.has_markup(F.col("text")))
    k = docs.select("doc_id", markup.kinds(F.col("text")).alias("a"), markup.kinds(markup.strip_markup(F.col("text"))).alias("b"))
    return k.select("doc_id", F.array_sort(F.array_except("a", "b")).alias("removed"), F.array_sort(F.array_except("b", "a")).alias("added"), F.array_sort(F.array_intersect("a", "b")).alias("common"), (F.size("a") - F.size("b")).alias("reduction"), F.round((F.size("b") - F.size("a")) / 11.0, 6).alias("diversity_change"))


@query(f"""WITH a AS (SELECT count(*) AS total, {', '.join(f"count(*) FILTER ({sql_kind('text', k)}) AS n_{k}" for k in markup.KINDS)} FROM documents)
SELECT r.kind, r.n, round(coalesce(100.0::DOUBLE * r.n / nullif(total, 0), 0), 6) AS percent FROM (SELECT total, unnest([{', '.join(f"{{'kind': '{k}', 'n': n_{k}}}" for k in markup.KINDS)}]) AS r FROM a)""")
def md_type_stats(spark, d):
    return audit.type_stats(spark.read.parquet(f"{d}/documents.parquet"))


@query(f"WITH {CORPUS} SELECT id, label, CASE WHEN label = 1 AND {sql_any('text')} THEN {sql_strip('text')} ELSE text END AS text FROM corpus")
def debias_b(spark, d):
    return audit.debiased(corpus(spark, d)).select("id", "label", "text")


@query(f"""WITH {CORPUS}, m AS (SELECT *, {sql_any('text')} AS md FROM corpus), r AS (SELECT *, row_number() OVER (PARTITION BY label, md ORDER BY md5('42|' || CAST(id AS VARCHAR)), id) AS rk, floor(count(*) OVER (PARTITION BY label) * 0.35::DOUBLE) AS goal, count(*) FILTER (md) OVER (PARTITION BY label) AS have FROM m)
SELECT id, label, CASE WHEN md AND rk > goal THEN {sql_strip('text')} WHEN NOT md AND rk <= goal - have THEN '## ' || text ELSE text END AS text FROM r""")
def debias_a(spark, d):
    return audit.rebalanced(corpus(spark, d), "id").select("id", "label", "text")


@query(f"""WITH {CORPUS}, m AS (SELECT label AS y, CAST({sql_any('text')} AS INT) AS b, CAST(CASE WHEN label = 1 AND {sql_any('text')} THEN {sql_any(sql_strip('text'))} ELSE {sql_any('text')} END AS INT) AS a FROM corpus),
s AS (SELECT abs(coalesce(avg(b) FILTER (y = 1), 0) - coalesce(avg(b) FILTER (y = 0), 0)) AS b0, abs(coalesce(avg(a) FILTER (y = 1), 0) - coalesce(avg(a) FILTER (y = 0), 0)) AS b1, avg(CAST(b = y AS DOUBLE)) AS c0, avg(CAST(a = y AS DOUBLE)) AS c1 FROM m)
SELECT round(b0, 6) AS bias_before, round(b1, 6) AS bias_after, round(b0 - b1, 6) AS bias_drop, round(c0, 6) AS rule_acc_before, round(c1, 6) AS rule_acc_after,
CASE WHEN b1 < 0.05 AND c1 < 0.5 THEN 'good' WHEN b1 < 0.10 AND c1 < 0.6 THEN 'fair' ELSE 'poor' END AS verdict FROM s""")
def debias_effect(spark, d):
    return audit.debias_effect(corpus(spark, d))


def sql_coin(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 4))::INT / 65536.0::DOUBLE)"


def _sql_line(key: str) -> str:
    i, bare = "CAST(i - 1 AS VARCHAR)", sql_trim("line")
    words = f"string_split(regexp_replace({bare}, '[{SPACE}]+', ' ', 'g'), ' ')"
    items = f"list_filter(list_transform(string_split({bare}, ','), lambda x: {sql_trim('x')}), lambda x: x <> '')"
    bold = f"CASE WHEN len({words}) >= 3 THEN '**' || {words}[1] || '** ' || array_to_string({words}[2:], ' ') ELSE {bare} END"
    listed = f"CASE WHEN len({items}) >= 2 THEN array_to_string(list_transform({items}, lambda x: '- ' || x), chr(10)) ELSE {bare} END"
    return f"""CASE WHEN {bare} = '' THEN '' WHEN i = 1 AND {sql_coin(key, i, "'title'")} < 0.2 THEN '## ' || {bare}
      WHEN length({bare}) < 50 AND {sql_coin(key, i, "'bold'")} < 0.3 THEN {bold} WHEN contains({bare}, ',') AND {sql_coin(key, i, "'list'")} < 0.25 THEN {listed} ELSE {bare} END"""


SQL_DRESSED = f"array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda line, i: {_sql_line('CAST(id AS VARCHAR)')}), chr(10))"


@query(f"WITH {CORPUS} SELECT id, {SQL_DRESSED} AS dressed FROM corpus")
def add_markup(spark, d):
    return corpus(spark, d).select("id", markup.add_markup(F.col("text"), F.col("id")).alias("dressed"))


_SCENARIOS = f"""WITH {CORPUS}, t AS (SELECT label, {sql_any('text')} AS base, {sql_any(sql_strip('text'))} AS plain, {sql_any(SQL_DRESSED)} AS formatted, {sql_coin('CAST(id AS VARCHAR)', "'side'")} < 0.5 AS side FROM corpus),
u AS (SELECT unnest([{{'scenario': 'baseline', 'md': base}}, {{'scenario': 'plain', 'md': plain}}, {{'scenario': 'formatted', 'md': formatted}}, {{'scenario': 'swapped', 'md': CASE WHEN label = 1 THEN plain ELSE formatted END}}, {{'scenario': 'random', 'md': CASE WHEN side THEN plain ELSE formatted END}}]) AS s, label FROM t),
g AS (SELECT s.scenario AS scenario, CAST(s.md AS INT) AS pred, label FROM u),
c AS (SELECT scenario, {SQL_CONFUSION} FROM g GROUP BY scenario), m AS (SELECT scenario, {SQL_PRF} FROM c), b AS (SELECT accuracy AS base FROM m WHERE scenario = 'baseline')"""


@query(_SCENARIOS + " SELECT scenario, accuracy, precision, recall, f1, round(base - accuracy, 6) AS drop_from_baseline FROM m, b")
def adversarial_grid(spark, d):
    return _grid(spark, d)


def _grid(spark, d):
    """The rule "has markup" on five transformations of the corpus, from one scan."""
    t = F.col("text")
    flags = corpus(spark, d).select("label", markup.has_markup(t).alias("base"), markup.has_markup(markup.strip_markup(t)).alias("plain"), markup.has_markup(markup.add_markup(t, F.col("id"))).alias("formatted"), (markup.coin(F.col("id"), "side") < 0.5).alias("side"))
    swapped = F.when(F.col("label") == 1, F.col("plain")).otherwise(F.col("formatted"))
    mixed = F.when(F.col("side"), F.col("plain")).otherwise(F.col("formatted"))
    cases = F.array(*[F.struct(F.lit(n).alias("scenario"), m.alias("md")) for n, m in (("baseline", F.col("base")), ("plain", F.col("plain")), ("formatted", F.col("formatted")), ("swapped", swapped), ("random", mixed))])
    each = flags.select("label", F.explode(cases).alias("c")).select("label", F.col("c.scenario").alias("scenario"), F.col("c.md").cast("int").alias("pred"))
    m = metrics.confusion(each, ["scenario"])
    base = m.filter("scenario = 'baseline'").select(F.col("accuracy").alias("base"))
    return m.crossJoin(F.broadcast(base)).select("scenario", "accuracy", "precision", "recall", "f1", F.round(F.col("base") - F.col("accuracy"), 6).alias("drop_from_baseline"))  # one row


@query(_SCENARIOS + ", x AS (SELECT max(base - accuracy) AS worst FROM m, b) SELECT round(worst, 6) AS max_drop, CASE WHEN worst < 0.05 THEN 'excellent' WHEN worst < 0.10 THEN 'good' WHEN worst < 0.20 THEN 'fair' ELSE 'poor' END AS grade FROM x")
def robustness_grade(spark, d):
    worst = _grid(spark, d).agg(F.max("drop_from_baseline").alias("w"))
    w = F.col("w")
    return worst.select(F.round(w, 6).alias("max_drop"), F.when(w < 0.05, "excellent").when(w < 0.10, "good").when(w < 0.20, "fair").otherwise("poor").alias("grade"))


@query(f"""SELECT doc_id, length(text)::INT AS n_chars, len(list_filter(string_split_regex(text, '\n{{2,}}'), lambda x: x <> ''))::INT AS n_paragraphs, len(string_split(text, chr(10)))::INT AS n_lines, {sql_kinds('text')} AS kinds FROM documents WHERE text IS NOT NULL""")
def layout_profile(spark, d):
    t = F.col("text")
    docs = spark.read.parquet(f"{d}/documents.parquet").filter("text is not null")
    return docs.select("doc_id", F.length(t).alias("n_chars"), F.size(F.filter(F.split(t, "\n{2,}"), lambda x: x != "")).alias("n_paragraphs"), F.size(F.split(t, "\n")).alias("n_lines"), markup.kinds(t).alias("kinds"))
