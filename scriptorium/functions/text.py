"""Scalar functions over text, as column expressions. Null in gives null out unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.classes import CJK, DIGIT, SPACE, WORD
from scriptorium.functions.markup import coin, strip_space

# Sentence marks, and what a sentence is.
SENTENCE = r"[^。！？!?]*[。！？!?]|[^。！？!?]+\z"
# What is neither text nor ordinary punctuation.
SPECIAL = rf'[^{WORD}{SPACE}.,!?;:()"—\-]'
# Chinese punctuation that is counted.
PUNCTUATION = r'[，。！？；："（）【】]'
# The register of a text, first match wins.
REGISTERS = (
    ("formal", "通知|公告|特此|敬请|请各位|温馨提示|须知"),
    ("technical", "算法|模型|神经网络|数据库|API|代码|训练|部署|实验|推理|调参"),
    ("casual", "哈哈|hh|嗯|啊|呀|哇|我觉得|说实话|有点"),
)
# Phrases of instruction-following replies.
TEMPLATE_LIKE = "(?i)分析请求|逐句分析|改进思路|好的，用户|用户希望|as an ai"
# Openings of a list or of reasoning that are taken out, and formal words with their casual ones.
CONNECTIVES = (
    "首先[，,]?", "其次[，,]?", "最后[，,]?", "总之[，,]?", "综上所述[，,]?", "总的来说[，,]?", "值得注意的是[，,]?", "需要指出的是[，,]?",
    "一方面.*另一方面", "不仅.*而且", "此外[，,]?", "另外[，,]?", "同时[，,]?", rf"\p{{Nd}}+\.[{SPACE}]*", rf"[一二三四五六七八九十][、.][{SPACE}]*",
)
CASUAL = (("因此", "所以"), ("然而", "但是"), ("尽管", "虽然"), ("此外", "还有"), ("例如", "比如"), ("即", "就是"), ("较为", "比较"), ("非常", "很"), ("十分", "挺"), ("能够", "能"), ("可以", "能"), ("应该", "得"))
PARTICLES = ("啊", "呢", "吧", "嘛", "哦", "呀")
# Words that mark a line as comment about the text.
COMMENT_WORDS = "版本|以下|改写|这是|好的"
PREAMBLE_WORDS = "版本|以下是|改写后|这是"
PREAMBLE_LINE_WORDS = "版本|以下是|改写"
REFUSALS = "作为一个AI|很抱歉"
TEMPLATE_PHRASES = "作为AI|我是一个|很抱歉"
TEMPLATE_WORDS = "(?:首先|其次|最后|综上所述)[，,]?"


def language(text: Column) -> Column:
    """chinese, mixed or non_chinese by the share of CJK characters; 'empty' for blank, 'unknown' for null."""
    total = F.length(strip_space(text))
    share = F.regexp_count(text, F.lit(f"[{CJK}]")) / F.when(total > 0, total)
    return F.when(text.isNull(), "unknown").when(total == 0, "empty").when(share > 0.5, "chinese").when(share > 0.1, "mixed").otherwise("non_chinese")


def special_ratio(text: Column) -> Column:
    """Share of characters outside letters, digits, white space and common marks; 1 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(SPECIAL)) / F.greatest(F.length(text), F.lit(1)).cast("double"), F.lit(1.0))


def sentences(text: Column) -> Column:
    """Sentences with their closing mark, blank ones dropped."""
    return F.filter(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda s: s.rlike(f"[^{SPACE}]"))


def clauses(text: Column, longer_than: int = 10) -> Column:
    """Trimmed pieces between full stops and line feeds that are longer than so many characters."""
    pieces = F.split(F.regexp_replace(text, "。", "。\n"), "\n")
    return F.filter(F.transform(pieces, strip_space), lambda s: F.length(s) > longer_than)


def register(text: Column) -> Column:
    out = F
    for name, words in REGISTERS:
        out = out.when(text.rlike(words), name)
    return out.otherwise("general")


def risk_flags(text: Column, confidence: Column, boundary_sentence: Column, kind: Column) -> Column:
    """What makes a verdict about a text doubtful, in fixed order."""
    n = F.length(text)
    return F.array_compact(
        F.array(
            F.when(n < 128, "short_text"),
            F.when(n > 2048, "long_text"),
            F.when(n > 5000, "extreme_length"),
            F.when(confidence < 65, "low_confidence"),
            F.when(text.rlike(TEMPLATE_LIKE), "template_like"),
            F.when((kind == "mixed") & boundary_sentence.isNull(), "mixed_without_boundary"),
        )
    )


def statistics(text: Column) -> dict[str, Column]:
    """Ten features of a text, in fixed order."""
    n = F.length(text)
    over = F.greatest(n, F.lit(1)).cast("double")
    words = F.regexp_count(text, F.lit(f"[^{SPACE}]+"))
    ends = F.regexp_count(text, F.lit("[。！？]")) + 1
    marks = F.regexp_count(text, F.lit(PUNCTUATION))
    return {
        "char_count": n,
        "word_count": words,
        "sentence_count": ends,
        "punct_ratio": marks / over,
        "avg_word_len": n / F.greatest(words, F.lit(1)).cast("double"),
        "avg_sent_len": n / ends.cast("double"),
        "char_diversity": F.when(n > 0, F.size(F.array_distinct(F.split(text, "")))).otherwise(0) / over,
        "digit_ratio": F.regexp_count(text, F.lit(f"[{DIGIT}]")) / over,
        "english_ratio": F.regexp_count(text, F.lit("[A-Za-z]")) / over,
        "punct_count": marks,
    }


def generation_quality(text: Column) -> Column:
    """0.5 to 1.0: length, structure and the absence of refusals. 0.5 for an empty text."""
    stops = F.regexp_count(text, F.lit("。"))
    tenths = F.lit(5) + F.when(F.length(text) >= 300, 2).otherwise(0) + F.when(text.contains("\n\n") | (stops >= 3), 1).otherwise(0) + F.when(~text.rlike(REFUSALS), 1).otherwise(0) + F.when(F.length(text) >= 500, 1).otherwise(0)
    return F.least(tenths, F.lit(10)) / F.lit(10.0)


def without_comments(text: Column) -> Column:
    """Lines longer than 30 characters without comment words in their first 20; null if none is left."""
    kept = F.filter(F.split(text, "\n"), lambda x: (F.length(x) > 30) & ~F.substring(x, 1, 20).rlike(COMMENT_WORDS))
    return F.when(F.size(kept) > 0, F.array_join(kept, "\n"))


def without_preamble(text: Column) -> Column:
    """If the first 50 characters announce a rewriting, the text from the first long line that doesn't."""
    bare = strip_space(text)
    lines = F.split(bare, "\n")
    starts = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: (F.length(F.element_at(lines, i)) > 50) & ~F.element_at(lines, i).rlike(PREAMBLE_LINE_WORDS))
    rest = F.array_join(F.slice(lines, F.try_element_at(starts, F.lit(1)), F.size(lines)), "\n")
    return F.when(F.substring(bare, 1, 50).rlike(PREAMBLE_WORDS) & (F.size(starts) > 0), rest).otherwise(bare)


def without_connectives(text: Column) -> Column:
    for pattern in CONNECTIVES:
        text = F.regexp_replace(text, "(?d)" + pattern, "")
    return text


def casual(text: Column, key: Column) -> Column:
    """Formal words replaced, each by its own coin, and with 0.3 a particle added to one sentence."""
    for i, (formal, word) in enumerate(CASUAL):
        # A word whose coin says no is looked for behind a control character, where it isn't: so each step holds the last one once.
        text = F.replace(text, F.when(coin(key, f"word{i}") > 0.5, formal).otherwise("\x01" + formal), F.lit(word))
    parts = F.split(text, "。")
    at = F.floor(coin(key, "place") * (F.size(parts) - 1)).cast("int")
    particle = F.element_at(F.array(*map(F.lit, PARTICLES)), (F.floor(coin(key, "particle") * len(PARTICLES)) + 1).cast("int"))
    marked = F.array_join(F.transform(parts, lambda s, i: F.when(i == at, F.concat(s, particle)).otherwise(s)), "。")
    return strip_space(F.when((coin(key, "add") > 0.7) & (F.size(parts) > 2), marked).otherwise(text))


def prefix_cut(text: Column, key: Column, low: float = 0.3, high: float = 0.5) -> Column:
    """How many characters a prefix of 30 to 50 % has, by a coin of ``key``."""
    a, b = F.floor(F.length(text) * low), F.floor(F.length(text) * high)
    return (a + F.floor(coin(key, "cut") * (b - a + 1))).cast("int")


def cleaned(text: Column) -> Column:
    """Template words and phrases out, runs of blanks and blank lines collapsed, trimmed."""
    text = F.regexp_replace(F.regexp_replace(text, TEMPLATE_WORDS, ""), TEMPLATE_PHRASES, "")
    return strip_space(F.regexp_replace(F.regexp_replace(text, "[ \t]+", " "), "\n{2,}", "\n"))


def chunks(text: Column, size: int = 1000, step: int = 500) -> Column:
    """Overlapping pieces: start (from 0) and text."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring(text, s + 1, F.lit(size)).alias("chunk")))


def preview(text: Column, size: int = 200) -> Column:
    return F.concat(F.substring(text, 1, size), F.when(F.length(text) > size, "...").otherwise(""))


def endpoint(url: Column) -> Column:
    """The chat endpoint of a service address."""
    bare = F.regexp_replace(url, "/+$", "")
    versioned = F.when(bare.endswith("/v1"), bare).otherwise(F.concat(bare, F.lit("/v1")))
    return F.when(bare.contains("/chat/completions"), bare).otherwise(F.concat(versioned, F.lit("/chat/completions")))


def truthy(value: Column) -> Column:
    return F.lower(F.trim(value)).isin("1", "true", "yes", "on")


def bearer(header: Column) -> Column:
    return F.nullif(F.regexp_extract(header, r"(?i)^Bearer\s+(.+)$", 1), F.lit(""))


def client_key(forwarded: Column, host: Column) -> Column:
    """The first forwarded hop, else the host, else 'unknown'."""
    return F.coalesce(F.when(forwarded != "", F.trim(F.element_at(F.split(forwarded, ","), 1))), F.nullif(host, F.lit("")), F.lit("unknown"))


def first_content(content: Column, reasoning: Column) -> Column:
    return F.coalesce(F.nullif(content, F.lit("")), reasoning, F.lit(""))


def label_number(label: Column) -> Column:
    """0 and 1 of labels written as numbers or as AI / Human; null for anything else."""
    return F.when(F.upper(label) == "AI", 1).when(F.upper(label) == "HUMAN", 0).when(label.isin("0", "1"), label.try_cast("int"))


def fill(template: Column, **values: Column) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template
