"""Text functions, markers and spans, plans, hybrid records, request limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import markup, spans, text
from scriptorium.functions.classes import DIGIT, SPACE
from scriptorium.operators import graph, integration, metrics, planning, ranges, records, sampling
from scriptorium.plans.curation import sql_rank
from scriptorium.plans.formats import sql_coin, sql_trim
from scriptorium.plans.registry import CORPUS, corpus, query, quoted, scored
from scriptorium.sources.readers import table
from scriptorium.streaming import limiter

def _t():
    return F.col("text")


def _docs(spark, d):
    return table(spark, d, "documents").filter("text is not null")


@query(f"SELECT doc_id, list_filter(regexp_extract_all(text, {quoted(text.SENTENCE)}), lambda s: regexp_matches(s, '[^{SPACE}]')) AS sentences FROM documents WHERE text IS NOT NULL")
def sentences(spark, d):
    return _docs(spark, d).select("doc_id", text.sentences(_t()).alias("sentences"))


@query(f"SELECT doc_id, list_filter(list_transform(string_split(replace(text, '。', '。' || chr(10)), chr(10)), lambda s: {sql_trim('s')}), lambda s: length(s) > 10) AS clauses FROM documents WHERE text IS NOT NULL")
def clauses(spark, d):
    return _docs(spark, d).select("doc_id", text.clauses(_t()).alias("clauses"))


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, {quoted(w)}) THEN '{n}'" for n, w in text.REGISTERS) + " ELSE 'general' END AS hint FROM documents WHERE text IS NOT NULL")
def domain_hint(spark, d):
    return _docs(spark, d).select("doc_id", text.register(_t()).alias("hint"))


def _n(pattern: str) -> str:
    return f"len(regexp_extract_all(text, {quoted(pattern)}))"


_OVER = "greatest(length(text), 1)::DOUBLE"
_ENDS = f"({_n('[。！？]')} + 1)"


@query(f"""SELECT doc_id, round(length(text), 6)::DOUBLE AS char_count, {_n(f'[^{SPACE}]+')}::DOUBLE AS word_count, {_ENDS}::DOUBLE AS sentence_count, round({_n(text.PUNCTUATION)} / {_OVER}, 6) AS punct_ratio, round(length(text) / greatest({_n(f'[^{SPACE}]+')}, 1)::DOUBLE, 6) AS avg_word_len,
round(length(text) / {_ENDS}::DOUBLE, 6) AS avg_sent_len, round(len(list_distinct(regexp_extract_all(text, '(?s).'))) / {_OVER}, 6) AS char_diversity, round({_n(f'[{DIGIT}]')} / {_OVER}, 6) AS digit_ratio, round({_n('[A-Za-z]')} / {_OVER}, 6) AS english_ratio, {_n(text.PUNCTUATION)}::DOUBLE AS punct_count FROM documents WHERE text IS NOT NULL""")
def stat_features(spark, d):
    return _docs(spark, d).select("doc_id", *[F.round(c.cast("double"), 6).alias(n) for n, c in text.statistics(_t()).items()])


@query(f"""WITH t AS (SELECT length(text)::DOUBLE AS n, {_n('[。！？]')}::DOUBLE AS e FROM train WHERE text IS NOT NULL), m AS (SELECT avg(n) AS mn, stddev_pop(n) AS sn, avg(e) AS me, stddev_pop(e) AS se FROM t)
SELECT row_id, round((length(text) - mn) / CASE WHEN sn > 0 THEN sn ELSE 1 END, 6) AS n, round(({_n('[。！？]')} - me) / CASE WHEN se > 0 THEN se ELSE 1 END, 6) AS e FROM val, m WHERE text IS NOT NULL""")
def standardize_features(spark, d):
    f = lambda name: table(spark, d, name).filter("text is not null").select("row_id", F.length(_t()).cast("double").alias("n"), F.regexp_count(_t(), F.lit("[。！？]")).cast("double").alias("e"))
    return metrics.standardized(f("train"), f("val"), ["n", "e"])


SQL_GEN_QUALITY = "least(5 + CASE WHEN length(T) >= 300 THEN 2 ELSE 0 END + CASE WHEN contains(T, chr(10) || chr(10)) OR len(regexp_extract_all(T, '。')) >= 3 THEN 1 ELSE 0 END + CASE WHEN NOT regexp_matches(T, '作为一个AI|很抱歉') THEN 1 ELSE 0 END + CASE WHEN length(T) >= 500 THEN 1 ELSE 0 END, 10) / 10.0::DOUBLE"


@query(f"WITH q AS (SELECT row_id, {SQL_GEN_QUALITY.replace('T)', 'text_content)').replace('(T,', '(text_content,')} AS quality FROM parallel_dataset WHERE text_content IS NOT NULL) SELECT row_id, quality, CASE WHEN quality > 0.8 THEN 'Excellent' WHEN quality > 0.6 THEN 'Good' ELSE 'OK' END AS band FROM q")
def gen_quality(spark, d):
    q = table(spark, d, "parallel_dataset").filter("text_content is not null").select("row_id", text.generation_quality(F.col("text_content")).alias("quality"))
    return q.withColumn("band", F.when(F.col("quality") > 0.8, "Excellent").when(F.col("quality") > 0.6, "Good").otherwise("OK"))


_LINES = "list_filter(string_split(text, chr(10)), lambda x: length(x) > 30 AND NOT regexp_matches(substr(x, 1, 20), '版本|以下|改写|这是|好的'))"


@query(f"SELECT row_id, CASE WHEN len({_LINES}) > 0 THEN array_to_string({_LINES}, chr(10)) END AS cleaned FROM full_dataset WHERE text IS NOT NULL")
def boilerplate_lines(spark, d):
    return table(spark, d, "full_dataset").filter("text is not null").select("row_id", text.without_comments(_t()).alias("cleaned"))


_BARE = sql_trim("text")


@query(f"""WITH b AS (SELECT row_id, {_BARE} AS bare FROM full_dataset WHERE text IS NOT NULL), l AS (SELECT row_id, bare, string_split(bare, chr(10)) AS ls FROM b),
s AS (SELECT *, list_filter(range(1, len(ls) + 1), lambda i: length(ls[i]) > 50 AND NOT regexp_matches(ls[i], '版本|以下是|改写')) AS starts FROM l)
SELECT row_id, CASE WHEN regexp_matches(substr(bare, 1, 50), '版本|以下是|改写后|这是') AND len(starts) > 0 THEN array_to_string(ls[starts[1]:], chr(10)) ELSE bare END AS body FROM s""")
def preamble_skip(spark, d):
    return table(spark, d, "full_dataset").filter("text is not null").select("row_id", text.without_preamble(_t()).alias("body"))


def _sql_connectives(x: str) -> str:
    for p in text.CONNECTIVES:
        x = f"regexp_replace({x}, {quoted(p)}, '', 'g')"
    return x


def _sql_casual(x: str, key: str) -> str:
    """A word whose coin says no is looked for behind a control character, where it isn't."""
    for i, (a, b) in enumerate(text.CASUAL):
        x = f"replace({x}, CASE WHEN {sql_coin(key, f"'word{i}'")} > 0.5 THEN '{a}' ELSE chr(1) || '{a}' END, '{b}')"
    return x


_KEY = "CAST(id AS VARCHAR)"
_HUMAN = f"""h AS (SELECT id, text, {_sql_casual(_sql_connectives('text'), _KEY)} AS t FROM corpus WHERE label = 1), p AS (SELECT *, string_split(t, '。') AS parts FROM h),
q AS (SELECT *, floor({sql_coin(_KEY, "'place'")} * (len(parts) - 1))::INT AS place, {list(text.PARTICLES)}[floor({sql_coin(_KEY, "'particle'")} * 6)::INT + 1] AS particle FROM p),
z AS (SELECT id, text, {sql_trim("CASE WHEN " + sql_coin(_KEY, "'add'") + " > 0.7 AND len(parts) > 2 THEN array_to_string(list_transform(parts, lambda s, i: CASE WHEN i - 1 = place THEN s || particle ELSE s END), '。') ELSE t END")} AS humanized FROM q)"""


def _humanized(spark, d):
    ai = corpus(spark, d).filter("label = 1")
    return ai.select("id", "text", text.casual(text.without_connectives(_t()), F.col("id")).alias("humanized"))


@query(f"WITH {CORPUS}, {_HUMAN} SELECT id, humanized FROM z")
def humanize(spark, d):
    return _humanized(spark, d).select("id", "humanized")


@query(f"""WITH {CORPUS}, {_HUMAN}, a AS (SELECT id, humanized AS text, 0 + 1 AS label, 'humanized_ai' AS type FROM (SELECT *, {sql_rank('id')} AS rk FROM z WHERE length(humanized) > 50 AND humanized <> text) WHERE rk <= 500),
u AS (SELECT id, text, 0 AS label, 'human' AS type FROM (SELECT *, {sql_rank('id')} AS rk FROM corpus WHERE label = 0) WHERE rk <= 500) SELECT * FROM a UNION ALL SELECT * FROM u""")
def hard_set(spark, d):
    changed = _humanized(spark, d).filter((F.length("humanized") > 50) & (F.col("humanized") != _t()))
    a = sampling.sample_n(changed, "id", 500).select("id", F.col("humanized").alias("text"), F.lit(1).alias("label"), F.lit("humanized_ai").alias("type"))
    h = sampling.sample_n(corpus(spark, d).filter("label = 0").select("id", "text"), "id", 500).select("id", "text", F.lit(0).alias("label"), F.lit("human").alias("type"))
    return a.unionByName(h)


@query(f"WITH {CORPUS} SELECT id, {sql_trim(f'''regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '{text.TEMPLATE_WORDS}', '', 'g'), '{text.TEMPLATE_PHRASES}', '', 'g'), '[ \t]+', ' ', 'g'), '\n{{2,}}', chr(10), 'g')''')} AS cleaned FROM corpus WHERE length(text) >= 300")
def text_clean(spark, d):
    return corpus(spark, d).filter(F.length(_t()) >= 300).select("id", text.cleaned(_t()).alias("cleaned"))


@query("SELECT doc_id, i::INT AS start, substr(text, i::INT + 1, 1000) AS chunk FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 1, 0) + 1, 500)) AS i FROM documents WHERE text IS NOT NULL)")
def chunk_overlap(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(text.chunks(_t())).alias("c")).select("doc_id", "c.start", "c.chunk")


@query("SELECT doc_id, substr(text, 1, 200) || CASE WHEN length(text) > 200 THEN '...' ELSE '' END AS preview, substr(text, 1, 400) AS head FROM documents WHERE text IS NOT NULL")
def previews(spark, d):
    return _docs(spark, d).select("doc_id", text.preview(_t()).alias("preview"), F.substring(_t(), 1, 400).alias("head"))


@query("SELECT doc_id, length(text) > 100 AS over_100, length(text) BETWEEN 50 AND 600 AS in_50_600, length(text) >= 80 AS from_80, length(text) > 30 AS over_30, length(text) > 50 AS over_50 FROM documents WHERE text IS NOT NULL")
def generator_gates(spark, d):
    n = F.length(_t())
    return _docs(spark, d).select("doc_id", (n > 100).alias("over_100"), n.between(50, 600).alias("in_50_600"), (n >= 80).alias("from_80"), (n > 30).alias("over_30"), (n > 50).alias("over_50"))


@query("SELECT doc_id, substr(text, 1, boundary) || '[SEP]' || substr(text, boundary + 1) AS marked FROM documents WHERE text IS NOT NULL AND boundary IS NOT NULL")
def sep_insert(spark, d):
    return _docs(spark, d).filter("boundary is not null").select("doc_id", spans.insert_mark(_t(), F.col("boundary")).alias("marked"))


_SHIFT = "CASE WHEN instr(text, '[SEP]') > 0 AND instr(text, '[SEP]') - 1 < 60 THEN 55 ELSE 60 END"


@query(f"SELECT row_id, replace(text, '[SEP]', '') AS plain, ({_SHIFT})::INT AS boundary, length(string_split(text, '[SEP]')[1])::INT AS human_part, coalesce(length(string_split(text, '[SEP]')[2]), 0)::INT AS ai_part FROM train WHERE text IS NOT NULL")
def sep_remove(spark, d):
    a, b = spans.part_lengths(_t())
    return table(spark, d, "train").filter("text is not null").select("row_id", spans.remove_marks(_t()).alias("plain"), spans.shifted(_t(), F.lit(60)).alias("boundary"), a.alias("human_part"), b.alias("ai_part"))


@query("SELECT category, count(*) AS n, count(*) FILTER (contains(text, '[SEP]')) AS n_marked FROM train GROUP BY category")
def marker_counts(spark, d):
    return table(spark, d, "train").groupBy("category").agg(F.count("*").alias("n"), F.count_if(_t().contains("[SEP]")).alias("n_marked"))


def _sql_aligned(boundary: str, name: str) -> str:
    return f"""{name} AS (SELECT id, i - 1 AS pos, token, b, CASE WHEN token IN ('[CLS]', '[SEP]', '[PAD]') THEN 0 ELSE length(replace(token, '##', '')) END AS size FROM (SELECT doc_id AS id, {boundary} AS b, generate_subscripts(regexp_extract_all(text, {quoted(spans.TOKEN)}), 1) AS i, unnest(regexp_extract_all(text, {quoted(spans.TOKEN)})) AS token FROM documents WHERE text IS NOT NULL AND boundary IS NOT NULL)),
{name}_at AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins FROM {name}),
{name}_l AS (SELECT id, pos::INT AS pos, token, begins, CASE WHEN token IN ('[CLS]', '[SEP]', '[PAD]') THEN -100 WHEN begins + size / 2.0::DOUBLE < b THEN 0 ELSE 1 END AS token_label FROM {name}_at)"""


def _marked(spark, d):
    return _docs(spark, d).filter("boundary is not null").select(F.col("doc_id").alias("id"), "text", "boundary", (F.col("boundary") + F.col("doc_id") % 13 - 6).cast("int").alias("guess"))


@query(f"WITH {_sql_aligned('boundary', 'a')} SELECT id, pos, token, begins AS at, token_label FROM a_l")
def token_align(spark, d):
    return spans.aligned(_marked(spark, d), "id", "text", "boundary")


_TRUE_GUESS = f"WITH {_sql_aligned('boundary', 'a')}, {_sql_aligned('boundary + doc_id % 13 - 6', 'g')}"


@query(_TRUE_GUESS + " SELECT count(*) AS n_tokens, round(avg(CAST(a_l.token_label = g_l.token_label AS DOUBLE)), 6) AS token_accuracy FROM a_l JOIN g_l ON a_l.id = g_l.id AND a_l.pos = g_l.pos WHERE a_l.token_label <> -100")
def token_accuracy(spark, d):
    a = spans.aligned(_marked(spark, d), "id", "text", "boundary").select("id", "pos", F.col("token_label").alias("y"))
    g = spans.aligned(_marked(spark, d), "id", "text", "guess").select("id", "pos", F.col("token_label").alias("p"))
    return a.join(g, ["id", "pos"]).filter("y <> -100").agg(F.count("*").alias("n_tokens"), F.round(F.avg((F.col("y") == F.col("p")).cast("double")), 6).alias("token_accuracy"))


def _transitions(rows):
    """First 0 to 1 transition of each text from its token labels, by a window over its tokens."""
    from pyspark.sql import Window

    before = F.lag("token_label").over(Window.partitionBy("id").orderBy("pos"))
    return rows.withColumn("before", before).groupBy("id").agg(F.min(F.when((F.col("before") == 0) & (F.col("token_label") == 1), F.col("pos"))).alias("first"))


_FIRST = "t AS (SELECT id, min(pos) FILTER (b = 0 AND token_label = 1) AS first FROM (SELECT *, lag(token_label) OVER (PARTITION BY id ORDER BY pos) AS b FROM a_l) GROUP BY id)"


@query(f"WITH {_sql_aligned('boundary', 'a')}, {_FIRST} SELECT id, first FROM t")
def first_transition(spark, d):
    return _transitions(spans.aligned(_marked(spark, d), "id", "text", "boundary"))


@query(_TRUE_GUESS + f", {_FIRST}, {_FIRST.replace('a_l', 'g_l').replace('t AS', 'u AS', 1)} SELECT count(*) AS n, round(avg(CAST(coalesce(abs(t.first - u.first) <= 5, false) AS DOUBLE)), 6) AS boundary_accuracy FROM t JOIN u ON t.id = u.id")
def boundary_accuracy(spark, d):
    a = _transitions(spans.aligned(_marked(spark, d), "id", "text", "boundary"))
    g = _transitions(spans.aligned(_marked(spark, d), "id", "text", "guess")).withColumnRenamed("first", "guess")
    near = F.coalesce(F.abs(F.col("first") - F.col("guess")) <= 5, F.lit(False))
    return a.join(g, "id").agg(F.count("*").alias("n"), F.round(F.avg(near.cast("double")), 6).alias("boundary_accuracy"))


@query(f"WITH {_sql_aligned('boundary', 'a')}, s AS (SELECT id, count(*) AS n, count(*) FILTER (token_label = 0) AS h, count(*) FILTER (token_label = 1) AS g FROM a_l GROUP BY id) SELECT count(*) AS n_texts, round(avg(n), 6) AS mean_tokens, round(avg(h), 6) AS mean_human, round(avg(g), 6) AS mean_ai FROM s")
def token_stats(spark, d):
    s = spans.aligned(_marked(spark, d), "id", "text", "boundary").groupBy("id").agg(F.count("*").alias("n"), F.count_if(F.col("token_label") == 0).alias("h"), F.count_if(F.col("token_label") == 1).alias("g"))
    return s.agg(F.count("*").alias("n_texts"), *[F.round(F.avg(c), 6).alias(f"mean_{m}") for c, m in (("n", "tokens"), ("h", "human"), ("g", "ai"))])


@query(f"WITH {_sql_aligned('boundary', 'a')}, {_FIRST} SELECT t.id, list(token ORDER BY pos) AS around FROM t JOIN a_l ON t.id = a_l.id WHERE pos >= greatest(first - 3, 0) AND pos < first + 3 GROUP BY t.id")
def around_boundary(spark, d):
    rows = spans.aligned(_marked(spark, d), "id", "text", "boundary")
    near = rows.join(_transitions(rows), "id").filter((F.col("pos") >= F.greatest(F.col("first") - 3, F.lit(0))) & (F.col("pos") < F.col("first") + 3))
    return near.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("around"))  # six at most


@query("WITH l AS (SELECT doc_id, list_transform(range(1, (doc_id % 700)::BIGINT + 1), lambda i: CASE WHEN i < doc_id % 97 THEN 0 ELSE 1 END) AS labels FROM documents) SELECT doc_id, list_concat(labels[1:512], list_transform(range(0, 512 - len(labels[1:512])), lambda i: -100)) AS padded, len(list_filter(labels, lambda x: x = 0))::INT AS n_human FROM l")
def label_padding(spark, d):
    labels = F.transform(F.when(F.col("doc_id") % 700 > 0, F.sequence(F.lit(1), (F.col("doc_id") % 700).cast("int"))).otherwise(F.array().cast("array<int>")), lambda i: F.when(i < F.col("doc_id") % 97, 0).otherwise(1))
    return table(spark, d, "documents").select("doc_id", labels.alias("labels")).select("doc_id", spans.padded(F.col("labels")).alias("padded"), F.size(F.filter("labels", lambda x: x == 0)).alias("n_human"))


def _sql_keyword(x: str, rules, default: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({x}, '{w}')" for w in words) + f" THEN '{name}'" for name, words in rules) + f" ELSE '{default}' END"


def _sql_pick(x: str, weights) -> str:
    total, out = 0, "CASE"
    for name, weight in weights:
        total += weight
        out += f" WHEN abs({x}) % 100 < {total} THEN '{name}'"
    return out + f" ELSE '{weights[-1][0]}' END"


_WORDS = "concat_ws(' ', coalesce(topic, ''), coalesce(genre, ''), coalesce(writer_role, ''), coalesce(prompt, ''))"


@query(f"""SELECT plan_id, {_sql_keyword(_WORDS, planning.DOMAINS, '社会')} AS topic_domain, {_sql_keyword(_WORDS, planning.PROMPT_TYPES, 'instruction')} AS prompt_type, CASE attribute {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in planning.TASKS.items())} ELSE 'other' END AS task_type,
{_sql_pick('(coalesce(plan_id, 0) + 17)', planning.FAMILIES)} AS model_family, {_sql_pick('(coalesce(plan_id, 0) + 59)', planning.DECODING)} AS decoding_profile, CASE WHEN {_sql_keyword(_WORDS, planning.PROMPT_TYPES, 'instruction')} = 'rewrite' THEN 'paraphrase' ELSE 'none' END AS rewrite_type, false AS generated_parallel, 'generated' AS source_license FROM generation_plan""")
def plan_normalize(spark, d):
    return planning.normalized(table(spark, d, "generation_plan"))


@query(f"SELECT {_sql_pick('(plan_id + 17)', planning.FAMILIES)} AS family, count(*) AS n FROM generation_plan GROUP BY ALL")
def weighted_pick(spark, d):
    return table(spark, d, "generation_plan").groupBy(planning.picked(F.col("plan_id") + 17, planning.FAMILIES).alias("family")).agg(F.count("*").alias("n"))


@query("SELECT plan_id FROM generation_plan WHERE NOT (coalesce(generated_parallel, false) OR coalesce(generated_deepseek, false) OR coalesce(generated_qwen, false)) ORDER BY plan_id LIMIT 100")
def pending_plan(spark, d):
    return planning.pending(table(spark, d, "generation_plan"), ["generated_parallel", "generated_deepseek", "generated_qwen"]).select("plan_id").orderBy("plan_id").limit(100)


@query("SELECT plan_id FROM generation_plan WHERE plan_id NOT IN (SELECT CAST(substr(text_id, 10) AS BIGINT) FROM parallel_dataset)")
def resume_plan(spark, d):
    done = table(spark, d, "parallel_dataset").select(F.substring("text_id", 10, 20).cast("bigint").alias("plan_id"))
    return table(spark, d, "generation_plan").select("plan_id").join(done, "plan_id", "left_anti")


@query("SELECT source_model, list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(source_model), '{p}')" for p in parts) + f" THEN '{n}' END" for n, parts in planning.FAMILY_NAMES.items()) + "], lambda x: x IS NOT NULL) AS families, count(*) AS n FROM parallel_dataset WHERE source_model IS NOT NULL GROUP BY ALL")
def model_families(spark, d):
    return table(spark, d, "parallel_dataset").filter("source_model is not null").groupBy("source_model", planning.families(F.col("source_model")).alias("families")).agg(F.count("*").alias("n"))


@query("WITH t AS (SELECT row_number() OVER (ORDER BY prompt) AS i, prompt FROM (SELECT DISTINCT replace(prompt, topic, '{topic}') AS prompt FROM generation_plan WHERE topic IS NOT NULL AND prompt IS NOT NULL) QUALIFY i <= 10), o AS (SELECT DISTINCT topic FROM generation_plan WHERE topic IS NOT NULL ORDER BY topic LIMIT 30) SELECT i::INT AS template, topic, replace(prompt, '{topic}', topic) AS prompt FROM t, o")
def template_topic_cross(spark, d):
    plan = table(spark, d, "generation_plan").filter("topic is not null and prompt is not null")
    templates = plan.select(F.replace("prompt", F.col("topic"), F.lit("{topic}")).alias("template_text")).distinct().orderBy("template_text").limit(10)
    numbered = templates.agg(F.array_sort(F.collect_list("template_text")).alias("all")).select(F.posexplode("all").alias("i", "template_text"))  # ten
    topics = table(spark, d, "generation_plan").filter("topic is not null").select("topic").distinct().orderBy("topic").limit(30)
    return planning.combinations(topics, numbered).select((F.col("i") + 1).alias("template"), "topic", text.fill(F.col("template_text"), topic=F.col("topic")).alias("prompt"))


_DIMENSIONS = (("attribute", 1), ("genre", 3), ("style", 7), ("topic", 13), ("writer_role", 29), ("constraint_text", 53))
_MIXED = " + ".join(f"{c}.h * {k}" for c, k in _DIMENSIONS)


@query("WITH " + ", ".join(f"{c} AS (SELECT {c} AS v, ('0x' || substr(md5({c}), 1, 4))::INT AS h FROM generation_plan WHERE {c} IS NOT NULL GROUP BY ALL)" for c, _ in _DIMENSIONS) + f""",
s AS (SELECT attribute.v AS attribute, genre.v AS genre, style.v AS style, (({_MIXED}) % 1000) / 1000.0::DOUBLE AS score FROM attribute, genre, style, topic, writer_role, constraint_text)
SELECT attribute, genre, style, count(*) AS n_combinations, count(*) FILTER (score >= 0.6) AS n_kept, round(avg(score) FILTER (score >= 0.6), 6) AS mean_score FROM s GROUP BY ALL""")
def combination_space(spark, d):
    plan = table(spark, d, "generation_plan")
    codes = {c: plan.filter(F.col(c).isNotNull()).select(c).distinct().select(c, (F.conv(F.substring(F.md5(c), 1, 4), 16, 10).cast("int") * k).alias(f"h_{c}")) for c, k in _DIMENSIONS}
    # The score is a sum modulo 1,000, so the dimensions that the result doesn't name are combined first and counted by what they add.
    named, others = ("attribute", "genre", "style"), ("topic", "writer_role", "constraint_text")
    added = planning.combinations(*(codes[c] for c in others)).groupBy((sum(F.col(f"h_{c}") for c in others) % 1000).alias("added")).agg(F.count("*").alias("n"))  # 1,000 rows at most
    all_ = planning.combinations(*(codes[c] for c in named), added).withColumn("score", (sum(F.col(f"h_{c}") for c in named) + F.col("added")) % 1000 / F.lit(1000.0))
    kept = F.when(F.col("score") >= 0.6, F.col("n"))
    return all_.groupBy(*named).agg(F.sum("n").alias("n_combinations"), F.coalesce(F.sum(kept), F.lit(0)).alias("n_kept"), F.round(F.try_divide(F.sum(F.when(F.col("score") >= 0.6, F.col("n") * F.col("score"))), F.sum(kept).cast("double")), 6).alias("mean_score"))


@query(f"WITH m AS (SELECT DISTINCT source_model AS m FROM parallel_dataset WHERE source_model IS NOT NULL), r AS (SELECT p.plan_id, m.m, row_number() OVER (PARTITION BY p.plan_id ORDER BY md5(p.plan_id || '|' || m.m), m.m) AS rk FROM generation_plan p, m) SELECT plan_id, string_agg(m, '+' ORDER BY rk) AS pair FROM r WHERE rk <= 2 GROUP BY plan_id")
def model_pairs(spark, d):
    names = table(spark, d, "parallel_dataset").filter("source_model is not null").agg(F.array_sort(F.collect_set("source_model")).alias("models"))  # the few models
    each = table(spark, d, "generation_plan").select("plan_id").crossJoin(F.broadcast(names))
    order = F.array_sort(F.transform("models", lambda m: F.struct(F.md5(F.concat_ws("|", F.col("plan_id").cast("string"), m)).alias("h"), m.alias("m"))))
    return each.select("plan_id", F.array_join(F.transform(F.slice(order, 1, 2), lambda x: x["m"]), "+").alias("pair"))


_CUT = f"(floor(length(text) * 0.3::DOUBLE) + floor({sql_coin(_KEY, chr(39) + 'cut' + chr(39))} * (floor(length(text) * 0.5::DOUBLE) - floor(length(text) * 0.3::DOUBLE) + 1)))::INT"


@query(f"WITH {CORPUS} SELECT id, {_CUT} AS cut, substr(text, 1, {_CUT}) AS head FROM corpus WHERE label = 0")
def prefix_cut(spark, d):
    return corpus(spark, d).filter("label = 0").withColumn("cut", text.prefix_cut(_t(), F.col("id"))).select("id", "cut", F.substring(_t(), F.lit(1), F.col("cut")).alias("head"))


@query(f"""WITH {CORPUS}, h AS (SELECT id, label, text, {_CUT} AS cut FROM corpus), n AS (SELECT doc_id AS id, text AS ai FROM documents WHERE text IS NOT NULL),
b AS (SELECT h.*, n.ai FROM h JOIN n ON n.id = h.id + 1),
c2 AS (SELECT substr(text, 1, cut) AS head, substr(text, 1, cut) || ai AS whole FROM b WHERE label = 0 AND length(ai) > 30),
u AS (SELECT substr(md5(whole), 1, 12) AS text_id, 'C2' AS category, 1 AS label, length(head)::INT AS boundary, 2 AS n_spans, length(whole)::INT AS last_end FROM c2
UNION ALL SELECT substr(md5(text), 1, 12), 'C1', 1, NULL, 1, length(text)::INT FROM corpus WHERE label = 1 AND length(text) > 50 UNION ALL SELECT substr(md5(text), 1, 12), 'C3', 1, NULL, 1, length(text)::INT FROM corpus WHERE category = 'C3' AND length(text) > 50
UNION ALL SELECT substr(md5(text), 1, 12), 'C4', 1, NULL, 1, length(text)::INT FROM corpus WHERE category = 'C4' AND length(text) > 50 UNION ALL SELECT substr(md5(text), 1, 12), 'Human', 0, NULL, 1, length(text)::INT FROM corpus WHERE label = 0) SELECT * FROM u""")
def record_builders(spark, d):
    c = corpus(spark, d)
    nxt = _docs(spark, d).select((F.col("doc_id") - 1).alias("id"), F.col("text").alias("ai"))
    human = c.filter("label = 0").withColumn("cut", text.prefix_cut(_t(), F.col("id")))
    all_ = integration.union([records.continued(human.join(nxt, "id"), "text", F.col("cut"), "ai"), records.pure(c.filter("label = 1")), records.edited(c.filter("category = 'C3'")), records.polished(c.filter("category = 'C4'")), records.human(c.filter("label = 0"))])
    return all_.select("text_id", "category", "label", "boundary", F.size("spans").alias("n_spans"), F.element_at("spans", -1)["end"].alias("last_end"))


@query("SELECT doc_id, CASE WHEN boundary IS NOT NULL THEN 'has' ELSE 'none' END AS boundary_present, 'c2_' || (row_number() OVER (ORDER BY doc_id) - 1) AS default_id FROM documents WHERE category = 'C2'")
def default_ids(spark, d):
    rows = table(spark, d, "documents").filter("category = 'C2'").select("doc_id", "boundary")
    numbered = ranges.numbered(rows, "doc_id")
    return numbered.select("doc_id", F.when(F.col("boundary").isNotNull(), "has").otherwise("none").alias("boundary_present"), F.concat(F.lit("c2_"), F.col("n")).alias("default_id"))


_GATES = {"C2": (80, None, 30, 300), "C3": (50, None, 50, 100), "C4": (50, 1000, 30, 200)}
_MADE = {
    "C2": f"SELECT 'C2' AS category, h.id, substr(h.text, 1, {_CUT}) || n.text AS text, {_CUT} AS boundary, length(h.text) AS given, length(n.text) AS made FROM corpus h JOIN documents n ON n.doc_id = h.id + 1 WHERE h.label = 0 AND n.text IS NOT NULL".replace("length(text)", "length(h.text)").replace("CAST(id AS VARCHAR)", "CAST(h.id AS VARCHAR)"),
    "C3": "SELECT 'C3', h.id, n.text, NULL, length(h.text), length(n.text) FROM corpus h JOIN documents n ON n.doc_id = h.id + 1 WHERE h.label = 1 AND n.text IS NOT NULL",
    "C4": "SELECT 'C4', h.id, n.text, NULL, length(h.text), length(n.text) FROM corpus h JOIN documents n ON n.doc_id = h.id + 1 WHERE h.label = 0 AND n.text IS NOT NULL",
}


@query(f"WITH {CORPUS}, m AS ({' UNION ALL '.join(_MADE.values())}), g AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY id) AS place FROM m WHERE " + " OR ".join(f"(category = '{c}' AND given >= {low}{f' AND given <= {high}' if high else ''} AND made > {least})" for c, (low, high, least, _) in _GATES.items()) + ") SELECT category, id, substr(md5(text), 1, 12) AS text_id, text, boundary::INT AS boundary, place::INT AS place FROM g WHERE " + " OR ".join(f"(category = '{c}' AND place <= {q})" for c, (*_, q) in _GATES.items()))
def generated_records(spark, d):
    c = corpus(spark, d).withColumnRenamed("text", "given")
    made = _docs(spark, d).select((F.col("doc_id") - 1).alias("id"), F.col("text").alias("made"))
    parts = {"C2": c.filter("label = 0").withColumn("cut", text.prefix_cut(F.col("given"), F.col("id"))), "C3": c.filter("label = 1"), "C4": c.filter("label = 0")}
    return integration.union([records.generator(rows.select("id", "given", *(["cut"] if "cut" in rows.columns else [])).join(made, "id"), name, *_GATES[name]) for name, rows in parts.items()])


@query("SELECT row_id, generated_at, try_cast(generated_at AS TIMESTAMP) AS at FROM parallel_dataset WHERE regexp_matches(generated_at, '^\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}:\\d{2}$')")
def iso_timestamps(spark, d):
    rows = table(spark, d, "parallel_dataset").filter(F.col("generated_at").rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}$"))
    return rows.select("row_id", "generated_at", F.try_to_timestamp(F.replace("generated_at", F.lit("T"), F.lit(" "))).cast("timestamp_ntz").alias("at"))


@query("SELECT source, count(*) AS n, count(*) FILTER (loaded_at > collected_at + INTERVAL 24 HOUR) AS n_expired FROM full_dataset GROUP BY source")
def cache_expiry(spark, d):
    return table(spark, d, "full_dataset").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("loaded_at") > F.col("collected_at") + F.expr("interval 24 hours")).alias("n_expired"))


@query("""WITH v AS (SELECT unnest([{'url': 'http://a.x/', 'auth': 'Bearer t1', 'fwd': ' 1.2.3.4 , 5.6.7.8', 'host': '9.9.9.9', 'flag': ' Yes ', 'label': 'AI', 'c': '', 'r': 'why'}, {'url': 'http://a.x/v1', 'auth': 'Basic t', 'fwd': '', 'host': '9.9.9.9', 'flag': 'off', 'label': '0', 'c': 'text', 'r': NULL}, {'url': 'http://a.x/v1/chat/completions', 'auth': 'bearer  t2', 'fwd': NULL, 'host': NULL, 'flag': '1', 'label': 'Human', 'c': NULL, 'r': NULL}], recursive := true)),
b AS (SELECT *, regexp_replace(url, '/+$', '') AS bare FROM v)
SELECT CASE WHEN contains(bare, '/chat/completions') THEN bare WHEN ends_with(bare, '/v1') THEN bare || '/chat/completions' ELSE bare || '/v1/chat/completions' END AS endpoint, nullif(regexp_extract(auth, '(?i)^Bearer\\s+(.+)$', 1), '') AS token, coalesce(CASE WHEN fwd <> '' THEN trim(string_split(fwd, ',')[1]) END, nullif(host, ''), 'unknown') AS client,
lower(trim(flag)) IN ('1', 'true', 'yes', 'on') AS enabled, CASE WHEN upper(label) = 'AI' THEN 1 WHEN upper(label) = 'HUMAN' THEN 0 WHEN label IN ('0', '1') THEN label::INT END AS label, coalesce(nullif(c, ''), r, '') AS content FROM b""")
def request_fields(spark, d):
    v = spark.sql("SELECT * FROM VALUES ('http://a.x/', 'Bearer t1', ' 1.2.3.4 , 5.6.7.8', '9.9.9.9', ' Yes ', 'AI', '', 'why'), ('http://a.x/v1', 'Basic t', '', '9.9.9.9', 'off', '0', 'text', NULL), ('http://a.x/v1/chat/completions', 'bearer  t2', NULL, NULL, '1', 'Human', NULL, NULL) AS t(url, auth, fwd, host, flag, label, c, r)")
    return v.select(text.endpoint(F.col("url")).alias("endpoint"), text.bearer(F.col("auth")).alias("token"), text.client_key(F.col("fwd"), F.col("host")).alias("client"), text.truthy(F.col("flag")).alias("enabled"), text.label_number(F.col("label")).alias("label"), text.first_content(F.col("c"), F.col("r")).alias("content"))


@query("""WITH RECURSIVE e AS (SELECT event_id AS id, event_type AS scope, coalesce(CAST(user_id AS VARCHAR), 'unknown') AS client, epoch_us(ts) / 1e6::DOUBLE AS ts, row_number() OVER (PARTITION BY event_type, coalesce(CAST(user_id AS VARCHAR), 'unknown') ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT id, scope, client, k, [ts] AS log, true AS admitted FROM e WHERE k = 1
UNION ALL SELECT id, scope, client, k, CASE WHEN len(kept) < 3 THEN list_append(kept, ts) ELSE kept END, len(kept) < 3 FROM (SELECT e.*, list_filter(r.log, lambda x: x >= e.ts - 86400.0) AS kept FROM r JOIN e ON e.scope = r.scope AND e.client = r.client AND e.k = r.k + 1))
SELECT id, scope, client, admitted FROM r""")
def rate_limit(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("scope"), F.col("user_id").cast("string").alias("client"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return limiter.limited(e.withColumn("ts", F.col("us") / 1e6), {}, window=86400.0, default=3).select("id", "scope", "client", "admitted")


_PIECES = f"regexp_extract_all(text, {quoted(f'[{SPACE}\\p{{P}}]+|[^{SPACE}\\p{{P}}]+')})"


_GRAPH = f"""WITH RECURSIVE p AS (SELECT doc_id, generate_subscripts({_PIECES}, 1) AS i, unnest({_PIECES}) AS piece FROM documents WHERE text IS NOT NULL),
a AS (SELECT doc_id, piece, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM p),
w AS (SELECT doc_id, lower(piece) AS w, begins FROM a WHERE regexp_matches(piece, '^[\\p{{L}}\\p{{N}}]')),
e AS (SELECT DISTINCT x.doc_id, least(x.w, y.w) AS a, greatest(x.w, y.w) AS b FROM w x JOIN w y ON x.doc_id = y.doc_id AND y.begins BETWEEN x.begins AND x.begins + 50 AND x.w <> y.w)"""


@query(_GRAPH + """,
n AS (SELECT doc_id, count(DISTINCT w) AS nodes FROM w GROUP BY doc_id), g AS (SELECT doc_id, x, count(*) AS d FROM (SELECT doc_id, a AS x FROM e UNION ALL SELECT doc_id, b FROM e) GROUP BY ALL),
t AS (SELECT doc_id, (sum(d) // 2)::BIGINT AS edges, sum(d * (d - 1) / 2)::DOUBLE AS triples FROM g GROUP BY doc_id),
c AS (SELECT x.doc_id, count(*) AS triangles FROM e x JOIN e y ON x.doc_id = y.doc_id AND x.b = y.a JOIN e z ON x.doc_id = z.doc_id AND x.a = z.a AND y.b = z.b GROUP BY x.doc_id)
SELECT n.doc_id, nodes, coalesce(edges, 0)::BIGINT AS edges, round(2.0 * coalesce(edges, 0) / nullif(nodes * (nodes - 1), 0)::DOUBLE, 6) AS density, round(2.0::DOUBLE * coalesce(edges, 0) / nodes, 6) AS avg_degree, round(coalesce(3.0::DOUBLE * coalesce(triangles, 0) / nullif(triples, 0), 0), 6) AS clustering
FROM n LEFT JOIN t ON n.doc_id = t.doc_id LEFT JOIN c ON n.doc_id = c.doc_id""")
def text_graph(spark, d):
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", "text")
    return graph.text_statistics(docs, "doc_id", "text")


@query(_GRAPH + """,
ways AS (SELECT doc_id, a AS x, b AS y FROM e UNION ALL SELECT doc_id, b, a FROM e),
d(doc_id, x, y, n) USING KEY (doc_id, x, y) AS (SELECT doc_id, x, y, 1 FROM ways UNION SELECT d.doc_id, d.x, w.y, d.n + 1 FROM d JOIN ways w ON d.doc_id = w.doc_id AND d.y = w.x AND d.x <> w.y LEFT JOIN recurring.d k ON k.doc_id = d.doc_id AND k.x = d.x AND k.y = w.y WHERE k.n IS NULL)
SELECT doc_id, round(avg(n), 6) AS avg_path_length FROM d GROUP BY doc_id""")
def graph_paths(spark, d):
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", "text")
    return graph.text_path_lengths(docs, "doc_id", "text")


@query(f"WITH {CORPUS} SELECT count(*) AS n, count(*) FILTER (pred = label) AS n_right, round(count(*) FILTER (pred = label) / 90.0::DOUBLE, 6) AS per_minute FROM scored")
def progress_rate(spark, d):
    return scored(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("pred") == F.col("label")).alias("n_right"), F.round(F.count_if(F.col("pred") == F.col("label")) / 90.0, 6).alias("per_minute"))
