"""Metrics of predictions and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import markup, maths, text
from scriptorium.functions.classes import SPACE
from scriptorium.operators import detection, metrics
from scriptorium.plans.curation import AUDIT_EDGES, sql_bin, sql_label
from scriptorium.plans.formats import SQL_CONFUSION, SQL_PRF, sql_any, sql_safe
from scriptorium.plans.registry import CORPUS, corpus, query, quoted, scored
from scriptorium.sources.readers import table

_HUMAN = f"round({sql_safe('tn', 'tn + fp')}, 6) AS human_accuracy"


@query(f"WITH {CORPUS}, c AS (SELECT {SQL_CONFUSION} FROM scored) SELECT *, {SQL_PRF}, {_HUMAN} FROM c")
def confusion(spark, d):
    return metrics.confusion(scored(spark, d))


@query(f"""WITH {CORPUS}, c AS (SELECT {SQL_CONFUSION} FROM scored), e AS (SELECT '0' AS class, {sql_safe('tn', 'tn + fn')} AS p, {sql_safe('tn', 'tn + fp')} AS r, {sql_safe('2 * tn', '2 * tn + fn + fp')} AS f, tn + fp AS support FROM c
UNION ALL SELECT '1', {sql_safe('tp', 'tp + fp')}, {sql_safe('tp', 'tp + fn')}, {sql_safe('2 * tp', '2 * tp + fp + fn')}, tp + fn FROM c),
u AS (SELECT * FROM e UNION ALL SELECT 'macro', avg(p), avg(r), avg(f), sum(support)::BIGINT FROM e UNION ALL SELECT 'weighted', sum(p * support) / sum(support), sum(r * support) / sum(support), sum(f * support) / sum(support), sum(support)::BIGINT FROM e)
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support FROM u""")
def class_report(spark, d):
    return metrics.report(scored(spark, d))


@query(f"WITH {CORPUS} SELECT s.pred, l.quality, l.toxic, count(*) AS n FROM scored s JOIN labels l ON s.id = l.doc_id GROUP BY ALL")
def prediction_alignment(spark, d):
    return scored(spark, d).join(table(spark, d, "labels").withColumnRenamed("doc_id", "id"), "id").groupBy("pred", "quality", "toxic").agg(F.count("*").alias("n"))


@query(f"WITH {CORPUS} SELECT category, count(*) AS n, count(*) FILTER (pred = label) AS n_correct, round(avg(CAST(pred = label AS DOUBLE)), 6) AS accuracy FROM scored WHERE category IN ('C2', 'C3', 'C4', 'Human') GROUP BY category")
def acc_by_category(spark, d):
    right = F.col("pred") == F.col("label")
    return scored(spark, d).filter(F.col("category").isin("C2", "C3", "C4", "Human")).groupBy("category").agg(F.count("*").alias("n"), F.count_if(right).alias("n_correct"), F.round(F.avg(right.cast("double")), 6).alias("accuracy"))


_BINS = f"WITH {CORPUS}, b AS (SELECT *, {sql_bin('length(text)', AUDIT_EDGES, True)} AS bin FROM scored), c AS (SELECT bin, {SQL_CONFUSION} FROM b WHERE bin IS NOT NULL GROUP BY bin), m AS (SELECT bin, tp, fp, tn, fn, {SQL_PRF}, {_HUMAN}, tp + fp + tn + fn AS n, {sql_label('bin', AUDIT_EDGES)} AS range FROM c)"


@query(_BINS + " SELECT * FROM m")
def acc_by_length_bin(spark, d):
    return metrics.by_bin(scored(spark, d), AUDIT_EDGES, F.length("text"))


@query(_BINS + " SELECT round(avg(accuracy), 6) AS mean_accuracy, round(var_pop(accuracy), 6) AS var_accuracy, round(avg(f1), 6) AS mean_f1, round(var_pop(f1), 6) AS var_f1, CASE WHEN var_pop(accuracy) < 0.01 THEN 'excellent' WHEN var_pop(accuracy) < 0.03 THEN 'good' WHEN var_pop(accuracy) < 0.05 THEN 'fair' ELSE 'poor' END AS grade FROM m")
def bin_variance(spark, d):
    return metrics.bin_variance(metrics.by_bin(scored(spark, d), AUDIT_EDGES, F.length("text")))


_ROC = f"""WITH {CORPUS}, g AS (SELECT prob_ai AS threshold, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM corpus GROUP BY prob_ai),
r AS (SELECT threshold, round(sum(p) OVER (ORDER BY threshold DESC)::DOUBLE / sum(p) OVER (), 6) AS tpr, round(sum(n) OVER (ORDER BY threshold DESC)::DOUBLE / sum(n) OVER (), 6) AS fpr FROM g)"""


@query(_ROC + " SELECT threshold, tpr, fpr FROM r")
def roc_curve(spark, d):
    return metrics.roc(corpus(spark, d), "prob_ai")


@query(_ROC + " SELECT threshold, tpr, fpr FROM r WHERE fpr <= 0.1")
def roc_low_fpr(spark, d):
    return metrics.roc(corpus(spark, d), "prob_ai").filter("fpr <= 0.1")


@query(f"""WITH {CORPUS}, r AS (SELECT label, rank() OVER (ORDER BY prob_ai) + (count(*) OVER (PARTITION BY prob_ai) - 1) / 2.0::DOUBLE AS rk FROM corpus), s AS (SELECT count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg, sum(rk) FILTER (label = 1) AS w FROM r)
SELECT n_pos, n_neg, round((w - n_pos * (n_pos + 1) / 2.0::DOUBLE) / (n_pos::DOUBLE * n_neg), 6) AS auc FROM s""")
def auc(spark, d):
    return metrics.auc(corpus(spark, d), "prob_ai")


@query(f"WITH {CORPUS} SELECT label, count(prob_ai) AS n, round(min(prob_ai), 6) AS min, round(max(prob_ai), 6) AS max, round(avg(prob_ai), 6) AS mean, round(quantile_cont(prob_ai, 0.5), 6) AS median, round(stddev_pop(prob_ai), 6) AS std FROM corpus GROUP BY label")
def prob_stats(spark, d):
    return metrics.score_stats(corpus(spark, d), "prob_ai", ["label"])


@query(f"WITH {CORPUS}, c AS (SELECT greatest(prob_ai, 1 - prob_ai) AS c, pred = label AS correct FROM scored) SELECT correct, least(floor((c - 0.5) / 0.01::DOUBLE), 49)::INT AS bin, count(*) AS n FROM c GROUP BY ALL")
def conf_histogram(spark, d):
    rows = scored(spark, d).withColumn("correct", F.col("pred") == F.col("label"))
    return metrics.histogram(rows, F.greatest("prob_ai", 1 - F.col("prob_ai")), 0.5, 1.0, 50, ["correct"])


@query(f"""WITH {CORPUS}, c AS (SELECT greatest(prob_ai, 1 - prob_ai) AS c, pred = label AS correct FROM scored), e AS (SELECT correct, min(c) AS lo, max(c) AS hi FROM c GROUP BY correct)
SELECT c.correct, CASE WHEN hi > lo THEN least(floor((c - lo) / ((hi - lo) / 30.0::DOUBLE)), 29) ELSE 0 END::INT AS bin, count(*) AS n FROM c JOIN e ON c.correct = e.correct GROUP BY ALL""")
def conf_histogram_own_range(spark, d):
    rows = scored(spark, d).select((F.col("pred") == F.col("label")).alias("correct"), F.greatest("prob_ai", 1 - F.col("prob_ai")).alias("c"))
    edges = rows.groupBy("correct").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    return metrics.histogram(rows.join(F.broadcast(edges), "correct"), F.col("c"), F.col("lo"), F.col("hi"), 30, ["correct"])  # two rows


@query(f"WITH {CORPUS} SELECT pred = label AS correct, count(*) AS n, round(avg(greatest(prob_ai, 1 - prob_ai)), 6) AS mean_confidence, round(avg(CAST(contains(text, '[SEP]') AS INT)), 6) AS marker_share, round(avg(length(text)), 6) AS mean_length FROM scored GROUP BY ALL")
def error_analysis(spark, d):
    rows = scored(spark, d).withColumn("correct", F.col("pred") == F.col("label"))
    return rows.groupBy("correct").agg(F.count("*").alias("n"), F.round(F.avg(F.greatest("prob_ai", 1 - F.col("prob_ai"))), 6).alias("mean_confidence"), F.round(F.avg(F.col("text").contains("[SEP]").cast("int")), 6).alias("marker_share"), F.round(F.avg(F.length("text")), 6).alias("mean_length"))


@query(f"WITH {CORPUS} SELECT id, prob_ai, label FROM scored WHERE pred <> label ORDER BY greatest(prob_ai, 1 - prob_ai) DESC, id LIMIT 3")
def worst_errors(spark, d):
    return scored(spark, d).filter("pred <> label").withColumn("c", F.greatest("prob_ai", 1 - F.col("prob_ai"))).orderBy(F.desc("c"), "id").limit(3).select("id", "prob_ai", "label")


@query(f"WITH {CORPUS}, x AS (SELECT avg(CAST(CAST({sql_any('text')} AS INT) = label AS DOUBLE)) AS rule, avg(CAST(pred = label AS DOUBLE)) AS model FROM scored) SELECT round(rule, 6) AS rule_accuracy, round(model, 6) AS model_accuracy, round(model - rule, 6) AS improvement FROM x")
def rule_vs_model(spark, d):
    right = lambda p: F.avg((p == F.col("label")).cast("double"))
    x = scored(spark, d).agg(right(markup.has_markup(F.col("text")).cast("int")).alias("r"), right(F.col("pred")).alias("m"))
    return x.select(F.round("r", 6).alias("rule_accuracy"), F.round("m", 6).alias("model_accuracy"), F.round(F.col("m") - F.col("r"), 6).alias("improvement"))


@query(f"WITH {CORPUS} SELECT count(*) FILTER (pred = 1) AS n_ai, count(*) FILTER (pred = 0) AS n_human, round(avg(pred) * 100, 6) AS ai_percent, round(avg(greatest(prob_ai, 1 - prob_ai)), 6) AS mean_confidence FROM scored")
def batch_summary(spark, d):
    return scored(spark, d).agg(F.count_if(F.col("pred") == 1).alias("n_ai"), F.count_if(F.col("pred") == 0).alias("n_human"), F.round(F.avg("pred") * 100, 6).alias("ai_percent"), F.round(F.avg(F.greatest("prob_ai", 1 - F.col("prob_ai"))), 6).alias("mean_confidence"))


@query(f"WITH {CORPUS} SELECT id, CASE WHEN greatest(prob_ai, 1 - prob_ai) >= 0.95 THEN 'very_high' WHEN greatest(prob_ai, 1 - prob_ai) >= 0.8 THEN 'high' WHEN greatest(prob_ai, 1 - prob_ai) >= 0.6 THEN 'medium' ELSE 'low' END AS tier FROM corpus")
def confidence_tier(spark, d):
    c = F.greatest("prob_ai", 1 - F.col("prob_ai"))
    return corpus(spark, d).select("id", F.when(c >= 0.95, "very_high").when(c >= 0.8, "high").when(c >= 0.6, "medium").otherwise("low").alias("tier"))


@query(f"WITH {CORPUS}, a AS (SELECT lang, avg(CAST(pred = label AS DOUBLE)) AS acc FROM scored WHERE lang IS NOT NULL GROUP BY lang) SELECT count(*) AS n_domains, round(avg(acc), 6) AS mean_accuracy, round(var_pop(acc), 6) AS variance, var_pop(acc) < 0.05 AS stable FROM a")
def cross_domain_variance(spark, d):
    a = scored(spark, d).filter("lang is not null").groupBy("lang").agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("acc"))
    return a.agg(F.count("*").alias("n_domains"), F.round(F.avg("acc"), 6).alias("mean_accuracy"), F.round(F.var_pop("acc"), 6).alias("variance"), (F.var_pop("acc") < 0.05).alias("stable"))


_LOSS = "-ln(greatest(CASE WHEN label = 1 THEN prob_ai ELSE 1 - prob_ai END, 1e-12))"
_TRUE = "CASE WHEN label = 1 THEN prob_ai ELSE 1 - prob_ai END"
_WEIGHT = "(1 + 0.3::DOUBLE * (1 - least(greatest(length(text) / 512.0::DOUBLE, 0), 1)))"


@query(f"WITH {CORPUS} SELECT id, round({_LOSS} * {_WEIGHT}, 6) AS loss, round({_LOSS} * {_WEIGHT} * (1 + 0.2::DOUBLE * (1 - {_TRUE})), 6) AS adaptive FROM corpus")
def weighted_loss(spark, d):
    p, y, n = F.col("prob_ai"), F.col("label"), F.length("text")
    return corpus(spark, d).select("id", F.round(maths.weighted_loss(p, y, n), 6).alias("loss"), F.round(maths.adaptive_loss(p, y, n), 6).alias("adaptive"))


@query(f"WITH {CORPUS}, l AS (SELECT label, pow(1 - {_TRUE}, 2) * -ln({_TRUE} + 1e-8) * {_WEIGHT} AS f, {_LOSS} * {_WEIGHT} AS w FROM corpus) SELECT label, round(avg(f), 6) AS focal, round(sum(f), 4) AS focal_sum, round(avg(w) + 0.5 * avg(f), 6) AS joint FROM l GROUP BY label")
def focal_loss(spark, d):
    p, y, n = F.col("prob_ai"), F.col("label"), F.length("text")
    f, w = maths.focal_loss(p, y, n), maths.weighted_loss(p, y, n)
    return corpus(spark, d).groupBy("label").agg(F.round(F.avg(f), 6).alias("focal"), F.round(F.sum(f), 4).alias("focal_sum"), F.round(maths.joint_loss(F.avg(w), F.avg(f)), 6).alias("joint"))


@query(f"""WITH {CORPUS}, z AS (SELECT id, ln((prob_ai + 1e-6) / (1 - prob_ai + 1e-6)) AS a FROM corpus), s AS (SELECT id, exp((a - greatest(a, 0)) / 0.8165::DOUBLE) AS x, exp((0 - greatest(a, 0)) / 0.8165::DOUBLE) AS y FROM z) SELECT id, round(x / (x + y), 6) AS p_ai, floor(x / (x + y) * 100)::INT AS ai_percent, floor(y / (x + y) * 100)::INT AS human_percent FROM s""")
def tempered_softmax(spark, d):
    p = F.col("prob_ai")
    a, b = maths.softmax2(F.ln((p + 1e-6) / (1 - p + 1e-6)), F.lit(0.0))
    return corpus(spark, d).select("id", F.round(a, 6).alias("p_ai"), maths.percent(a).alias("ai_percent"), maths.percent(b).alias("human_percent"))


@query(f"WITH {CORPUS} SELECT id, round(0.4::DOUBLE * prob_ai + 0.3::DOUBLE * (id % 7) / 7.0::DOUBLE + 0.2::DOUBLE * (id % 11) / 11.0::DOUBLE + 0.1::DOUBLE * (id % 13) / 13.0::DOUBLE, 6) AS vote FROM corpus")
def ensemble_vote(spark, d):
    part = lambda m: (F.col("id") % m) / F.lit(float(m))
    return corpus(spark, d).select("id", F.round(maths.vote(F.col("prob_ai"), part(7), part(11), part(13)), 6).alias("vote"))


@query("WITH e AS (SELECT unnest([1, 2, 3, 4, 5, 6]) AS epoch, unnest([0.9, 0.5, 0.42, 0.42, 0.45, 0.5]::DOUBLE[]) AS val_loss, unnest([0.7, 0.85, 0.9, 0.9, 0.91, 0.88]::DOUBLE[]) AS val_f1) SELECT (SELECT min(epoch) FROM e WHERE val_loss = (SELECT min(val_loss) FROM e))::INT AS best_by_loss, (SELECT min(epoch) FROM e WHERE val_f1 = (SELECT max(val_f1) FROM e))::INT AS best_by_f1")
def best_epoch(spark, d):
    history = spark.sql("SELECT array(0.9D, 0.5D, 0.42D, 0.42D, 0.45D, 0.5D) AS val_loss, array(0.7D, 0.85D, 0.9D, 0.9D, 0.91D, 0.88D) AS val_f1")
    e = history.select(F.posexplode(F.arrays_zip("val_loss", "val_f1")).alias("i", "r")).select((F.col("i") + 1).alias("epoch"), "r.val_loss", "r.val_f1")
    return e.agg(F.min_by("epoch", F.struct("val_loss", "epoch")).alias("best_by_loss"), F.min_by("epoch", F.struct(-F.col("val_f1"), F.col("epoch"))).alias("best_by_f1"))


@query(f"WITH {CORPUS}, l AS (SELECT floor(id / 16) AS batch, {_LOSS} AS x FROM corpus) SELECT round(avg(m), 6) AS mean_of_batches FROM (SELECT batch, avg(x) AS m FROM l GROUP BY batch)")
def mean_of_batch_means(spark, d):
    rows = corpus(spark, d).select(F.floor(F.col("id") / 16).alias("batch"), (-F.ln(F.greatest(maths.true_probability(F.col("prob_ai"), F.col("label")), F.lit(1e-12)))).alias("x"))
    return rows.groupBy("batch").agg(F.avg("x").alias("m")).agg(F.round(F.avg("m"), 6).alias("mean_of_batches"))


_DECIDED = f"""WITH {CORPUS}, p AS (SELECT *, floor(prob_ai * 100)::INT AS ai_percent, floor((1 - prob_ai) * 100)::INT AS human_percent, CASE WHEN prob_ai > 0.5 THEN 'AI' ELSE 'Human' END AS label_name, greatest(prob_ai, 1 - prob_ai) * 100 AS confidence FROM corpus),
f AS (SELECT *, CASE WHEN ai_percent > 80 THEN 'ai' WHEN human_percent > 80 THEN 'human' ELSE 'mixed' END AS first FROM p), b AS (SELECT *, CASE WHEN first IN ('ai', 'mixed') OR label_name = 'AI' THEN boundary END AS boundary_char FROM f),
k AS (SELECT *, CASE WHEN boundary_char IS NOT NULL THEN 'mixed' WHEN first = 'mixed' THEN CASE WHEN prob_ai > 1 - prob_ai THEN 'ai' ELSE 'human' END ELSE first END AS kind FROM b),
s AS (SELECT id, kind, boundary_char, ai_percent, confidence, text, list_filter(regexp_extract_all(text, {quoted(text.SENTENCE)}), lambda x: regexp_matches(x, '[^{SPACE}]')) AS sents FROM k),
e AS (SELECT id, kind, boundary_char, ai_percent, generate_subscripts(sents, 1) AS i, unnest(sents) AS sentence FROM s),
o AS (SELECT *, coalesce(sum(length(sentence)) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM e),
h AS (SELECT id, max(i - 1) FILTER (boundary_char >= begins AND boundary_char < begins + length(sentence))::INT AS hit FROM o GROUP BY id)"""


@query(_DECIDED + " SELECT id, ai_percent, human_percent, boundary_char, kind, round(confidence, 6) AS confidence FROM k")
def detect_decision(spark, d):
    return detection.decided(corpus(spark, d)).select("id", "ai_percent", "human_percent", "boundary_char", "kind", F.round("confidence", 6).alias("confidence"))


@query(_DECIDED + " SELECT o.id, (i - 1)::INT AS idx, sentence, CASE WHEN kind = 'ai' THEN true WHEN kind = 'human' THEN false WHEN hit IS NOT NULL THEN i - 1 >= hit ELSE ai_percent > 50 END AS is_ai FROM o JOIN h ON o.id = h.id")
def sentence_attribution(spark, d):
    return detection.attributed(corpus(spark, d), "id")


@query(_DECIDED + f""" SELECT s.id, list_filter([CASE WHEN length(text) < 128 THEN 'short_text' END, CASE WHEN length(text) > 2048 THEN 'long_text' END, CASE WHEN length(text) > 5000 THEN 'extreme_length' END, CASE WHEN confidence < 65 THEN 'low_confidence' END,
CASE WHEN regexp_matches(text, {quoted(text.TEMPLATE_LIKE)}) THEN 'template_like' END, CASE WHEN kind = 'mixed' AND hit IS NULL THEN 'mixed_without_boundary' END], lambda x: x IS NOT NULL) AS flags FROM s LEFT JOIN h ON s.id = h.id""")
def risk_flags(spark, d):
    return detection.response(corpus(spark, d), "id").select("id", F.col("riskFlags").alias("flags"))


@query()
def detect_response(spark, d):
    return detection.response(corpus(spark, d), "id")


@query()
def detect_report(spark, d):
    from scriptorium.sources.sinks import report

    return report(detection.response(corpus(spark, d), "id"))


@query("""WITH s AS (SELECT a.vec_id AS query, b.vec_id AS match, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query, match, similarity, similarity >= 0.85 AS kept FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY similarity DESC, match) = 1""")
def similarity_gate(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return detection.gated(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding")


@query("SELECT p.row_id, round(levenshtein(g.prompt, p.prompt)::DOUBLE / nullif(length(g.prompt), 0), 6) AS edit_share FROM parallel_dataset p JOIN generation_plan g ON CAST(substr(p.text_id, 10) AS BIGINT) = g.plan_id")
def edit_share(spark, d):
    p = table(spark, d, "parallel_dataset").select("row_id", "prompt", F.substring("text_id", 10, 20).cast("bigint").alias("plan_id"))
    g = table(spark, d, "generation_plan").select("plan_id", F.col("prompt").alias("planned"))
    return p.join(g, "plan_id").select("row_id", F.round(maths.edit_share(F.col("planned"), F.col("prompt")), 6).alias("edit_share"))
