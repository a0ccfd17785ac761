"""Detecting, counting, stripping and adding light markup, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.classes import DECIMAL, EDGES, LINES, SPACE

_S, _D = f"[{SPACE}]", f"[{DECIMAL}]"

# The replacements that strip markup, in their order. "1" keeps the first group.
STRIP = (
    (r"```[^`]*```", ""),
    (r"`([^`]+)`", "1"),
    (r"!\[[^\]]*\]\([^\)]+\)", ""),
    (r"\[([^\]]+)\]\([^\)]+\)", "1"),
    (rf"^#{{1,6}}{_S}+", ""),
    (r"\*\*\*([^*]+)\*\*\*", "1"),
    (r"\*\*([^*]+)\*\*", "1"),
    (r"__([^_]+)__", "1"),
    (r"_([^_]+)_", "1"),
    (r"\*([^*]+)\*", "1"),
    (rf"^[\-\*\+]{_S}+", ""),
    (rf"^{_D}+\.{_S}+", ""),
    (rf"^>{_S}+", ""),
    (r"^[\-*_]{3,}$", ""),
    (r"^\|[^\n]+\|$", ""),
    (rf"^\|[{SPACE}\-:]+\|$", ""),
    (r"~~([^~]+)~~", "1"),
    (r"==([^=]+)==", "1"),
    (r"<[^>]+>", ""),
    (r"\n{3,}", "\n\n"),
    (r"[ \t]+\n", "\n"),
)

# What counts as markup at all.
ANY = (r"\*\*[^*]+\*\*", rf"^#{{1,6}}{_S}", rf"^[\-\*\+]{_S}", r"^[\-*_]{3,}$", r"```")

# The eleven kinds of markup.
KINDS = {
    "title": rf"^#{{1,6}}{_S}",
    "bold": r"\*\*[^*]+\*\*|__[^_]+__",
    "italic": r"_[^_]+_|\*[^*]+\*",
    "list": rf"^[\-\*\+]{_S}|^{_D}+\.{_S}",
    "code_block": r"```",
    "inline_code": r"`[^`]+`",
    "divider": r"^[\-*_]{3,}$",
    "quote": rf"^>{_S}",
    "link": r"\[[^\]]+\]\([^\)]+\)",
    "image": r"!\[[^\]]*\]\([^\)]+\)",
    "table": r"^\|[^\n]+\|",
}

# What is counted of seven kinds.
COUNTED = {
    "title": rf"^#{{1,6}}{_S}",
    "bold": r"\*\*[^*]+\*\*|__[^_]+__",
    "list": rf"^(?:[\-\*\+]|{_D}+\.){_S}",
    "code_block": r"```[^`]*```",
    "inline_code": r"`[^`]+`",
    "link": r"\[[^\]]+\]\([^\)]+\)",
    "image": r"!\[[^\]]*\]\([^\)]+\)",
}


def strip_space(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, EDGES, "")


def strip_markup(text: Column) -> Column:
    """One ordered pass over all rules, then trimmed. Null stays null. A prefix that an earlier rule uncovers stays."""
    for pattern, kept in STRIP:
        text = F.regexp_replace(text, LINES + pattern, "$1" if kept == "1" else kept)
    return strip_space(text)


def strip_markup_fixpoint(text: Column) -> Column:
    """Passes until one changes nothing, however deep prefixes nest. Null stays null.

    A pass that changes a text makes it shorter, so there are at most as many as characters; when one has changed nothing, the rest aren't run.
    """
    first = strip_markup(text)
    start = F.struct(first.alias("t"), (first == text).alias("done"))
    again = lambda s: F.element_at(F.transform(F.array(strip_markup(s["t"])), lambda n: F.struct(n.alias("t"), (n == s["t"]).alias("done"))), 1)
    return F.aggregate(F.sequence(F.lit(0), F.length(first)), start, lambda s, _: F.when(s["done"], s).otherwise(again(s)), lambda s: s["t"])


def has_markup(text: Column) -> Column:
    """Whether any of the five patterns is found; false for null."""
    found = F.lit(False)
    for pattern in ANY:
        found = found | text.rlike(LINES + pattern)
    return F.coalesce(found, F.lit(False))


def has_kind(text: Column, kind: str) -> Column:
    return F.coalesce(text.rlike(LINES + KINDS[kind]), F.lit(False))


def kinds(text: Column) -> Column:
    """The kinds of markup found, in their fixed order; an empty array for null."""
    return F.array_compact(F.array(*(F.when(has_kind(text, k), F.lit(k)) for k in KINDS)))


def diversity(text: Column) -> Column:
    return F.size(kinds(text)) / F.lit(float(len(KINDS)))


def count_kind(text: Column, kind: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(LINES + COUNTED[kind])), F.lit(0))


def title_levels(text: Column) -> Column:
    """The distinct levels of titles, ascending; an empty array for null."""
    marks = F.regexp_extract_all(text, F.lit(LINES + rf"^(#{{1,6}}){_S}"), F.lit(1))
    return F.coalesce(F.array_sort(F.array_distinct(F.transform(marks, F.length))), F.array().cast("array<int>"))


def coin(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends on nothing but the parts: the first 16 bits of their md5."""
    key = F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(key), 1, 4), 16, 10).cast("int") / F.lit(65536.0)


def add_markup(text: Column, key: Column) -> Column:
    """Markup as a writer might add it, by coins of ``key`` and line: a title 0.2, a bold first word 0.3, a list 0.25.

    A null text becomes empty.
    """
    lines = F.split(F.coalesce(text, F.lit("")), "\n")

    def dress(line: Column, i: Column) -> Column:
        bare = strip_space(line)
        words = F.split(F.regexp_replace(bare, f"[{SPACE}]+", " "), " ")
        items = F.filter(F.transform(F.split(bare, ","), strip_space), lambda x: x != "")
        title = (i == 0) & (coin(key, i, "title") < 0.2)
        short = (F.length(bare) < 50) & (coin(key, i, "bold") < 0.3)
        listed = bare.contains(",") & (coin(key, i, "list") < 0.25)
        bold = F.when(F.size(words) >= 3, F.concat(F.lit("**"), F.element_at(words, 1), F.lit("** "), F.array_join(F.slice(words, F.lit(2), F.size(words)), " "))).otherwise(bare)
        items_ = F.when(F.size(items) >= 2, F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise(bare)
        return F.when(bare == "", F.lit("")).when(title, F.concat(F.lit("## "), bare)).when(short, bold).when(listed, items_).otherwise(bare)

    return F.array_join(F.transform(lines, dress), "\n")
