"""Generation plans: classification by keywords, weighted picks, pending rows, quotas, combinations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Topic domains by keyword, the first match wins.
DOMAINS = (
    ("对话", ("对话", "访谈", "问答", "采访", "聊天", "交流")),
    ("学术", ("论文", "学术", "实验", "研究", "摘要", "方法", "结论", "文献")),
    ("教育", ("教育", "学校", "学生", "教师", "老师", "教学", "课堂", "学习", "考试")),
    ("健康", ("健康", "医疗", "医学", "医院", "心理", "疾病", "诊断", "疫苗")),
    ("经济", ("经济", "金融", "市场", "商业", "企业", "贸易", "产业", "消费", "投资", "GDP")),
    ("文化", ("文化", "艺术", "文学", "历史", "传统", "哲学", "审美")),
    ("科技", ("科技", "人工智能", "AI", "算法", "计算", "互联网", "软件", "硬件", "机器人", "区块链", "量子", "芯片")),
    ("社会", ("社会", "公共", "政策", "治理", "法律", "伦理", "公平", "城市", "社区", "民生")),
)
# Prompt types by keyword, tasks by attribute, and weights in percent.
PROMPT_TYPES = (("dialogue", ("对话", "访谈", "问答", "采访")), ("continuation", ("续写",)), ("rewrite", ("改写",)), ("summary", ("摘要",)))
TASKS = {"说明": "expository", "议论": "argumentative", "记叙": "narrative", "描写": "descriptive", "抒情": "lyrical"}
# Shares of the quota matrix by topic domain, length and attribute.
DOMAIN_SHARES = {"科技": 0.15, "社会": 0.15, "教育": 0.1, "健康": 0.1, "文化": 0.1, "经济": 0.1, "学术": 0.15, "对话": 0.15}
LENGTH_EDGES = (300.0, 600.0, 1200.0, 2000.0, float("inf"))
LENGTH_SHARES = {"300-600": 0.3, "600-1200": 0.3, "1200-2000": 0.2, "2000-inf": 0.2}
ATTRIBUTE_SHARES = {"说明": 0.2, "议论": 0.2, "记叙": 0.2, "描写": 0.2, "抒情": 0.2}
FAMILIES = (("gpt", 20), ("claude", 20), ("gemini", 20), ("deepseek", 20), ("qwen", 20))
DECODING = (("low", 30), ("medium", 50), ("high", 20))
# Name parts of model families; a name may belong to several.
FAMILY_NAMES = {"gpt": ("gpt", "openai"), "claude": ("claude",), "gemini": ("gemini",), "deepseek": ("deepseek",), "qwen": ("qwen", "kimi")}


def by_keyword(text: Column, rules: tuple[tuple[str, tuple[str, ...]], ...], default: str) -> Column:
    out = F
    for name, words in rules:
        out = out.when(reduce(lambda a, b: a | b, [text.contains(w) for w in words]), name)
    return out.otherwise(default)


def picked(seed: Column, weights: tuple[tuple[str, int], ...]) -> Column:
    """The name in whose cumulative weight |seed| mod 100 falls."""
    at, total, out = F.abs(seed) % 100, 0, F
    for name, weight in weights:
        total += weight
        out = out.when(at < total, name)
    return out.otherwise(weights[-1][0])


def families(model: Column) -> Column:
    """All families whose name parts a model's name holds, in fixed order."""
    low = F.lower(model)
    return F.array_compact(F.array(*[F.when(reduce(lambda a, b: a | b, [low.contains(p) for p in parts]), name) for name, parts in FAMILY_NAMES.items()]))


def normalized(plan: DataFrame) -> DataFrame:
    """Each plan row with its domain, prompt type, task, picks and reset flags. Null ids pick as 0, null texts as empty."""
    words = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("topic", "genre", "writer_role", "prompt")])
    kind = by_keyword(words, PROMPT_TYPES, "instruction")
    seed = F.coalesce(F.col("plan_id"), F.lit(0))
    task = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TASKS.items() for x in kv]), F.col("attribute")), F.lit("other"))
    return plan.select(
        "plan_id", by_keyword(words, DOMAINS, "社会").alias("topic_domain"), kind.alias("prompt_type"), task.alias("task_type"),
        picked(seed + 17, FAMILIES).alias("model_family"), picked(seed + 59, DECODING).alias("decoding_profile"),
        F.when(kind == "rewrite", "paraphrase").otherwise("none").alias("rewrite_type"), F.lit(False).alias("generated_parallel"), F.lit("generated").alias("source_license"),
    )


def pending(plan: DataFrame, flags: list[str]) -> DataFrame:
    """Rows none of whose flags is set; a null flag isn't set."""
    done = reduce(lambda a, b: a | b, [F.coalesce(F.col(f), F.lit(False)) for f in flags])
    return plan.filter(~done)


#: Values of one dimension up to this number are broadcast to be combined.
MOST_VALUES = 100_000


def combinations(*frames: DataFrame) -> DataFrame:
    """Every combination of dimension tables. All but the first are broadcast, each after its rows are counted; a larger one is an error."""
    for f in frames[1:]:
        if f.limit(MOST_VALUES + 1).count() > MOST_VALUES:
            raise ValueError(f"a dimension of more than {MOST_VALUES} values: {f.columns}")
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), frames)


def quotas(dimensions: list[dict[str, float]], names: list[str], rows: DataFrame) -> DataFrame:
    """The product of share tables as targets for the number of ``rows``: one row a combination with ``target``."""
    frames = [rows.sparkSession.createDataFrame([(k, float(v)) for k, v in d.items()], f"{n} string, __s{i} double") for i, (d, n) in enumerate(zip(dimensions, names))]
    out = combinations(*frames, rows.agg(F.count("*").alias("__total")))
    share = reduce(lambda a, b: a * b, [F.col(f"__s{i}") for i in range(len(frames))])
    return out.select(*names, F.round(share * F.col("__total"), 6).alias("target"))


def against(targets: DataFrame, rows: DataFrame, names: list[str], tolerance: float = 0.1) -> DataFrame:
    """Actual counts beside their targets, the deviation, and whether it is within the tolerance."""
    have = rows.groupBy(*names).agg(F.count("*").alias("actual"))
    j = targets.join(have, names, "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    off = F.try_divide(F.col("actual") - F.col("target"), F.col("target"))
    return j.select(*names, "target", "actual", F.round(off, 6).alias("deviation"), F.coalesce(F.abs(off) <= tolerance, F.lit(False)).alias("within"))
