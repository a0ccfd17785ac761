"""Values derived by hand from what the rules say."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import markup, maths, spans, text
from scriptorium.operators import planning


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(f(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "given, want",
    [
        ("# a\n\n\n\nb  \nc", "a\n\nb\nc"),
        ("**b** and __c__ and _d_ and *e*", "b and c and d and e"),
        ("***bi***", "bi"),
        ("- x\n1. y\n> z", "x\ny\nz"),
        ("- - x", "- x"),
        ("1. - x", "- x"),
        ("> - x", "- x"),
        ("a\n---\nb", "a\n\nb"),
        ("---\r\nx", "---\r\nx"),
        ("![i](u) [t](u)", "t"),
        ("![i]()", "![i]()"),
        ("`k` ```x\ny``` z", "k  z"),
        ("|a|b|\n|--|--|\nend", "end"),
        ("~~s~~ ==h== <b>t</b>", "s h t"),
        ("-　x", "x"),
        ("１. x", "x"),
        ("　a　\n", "a"),
        ("", ""),
        (None, None),
    ],
)
def test_strip(spark, given, want):
    assert one(spark, given, markup.strip_markup) == want


def test_nested_prefixes_go_with_more_passes(spark):
    assert one(spark, "- - x", markup.strip_markup_fixpoint) == "x"


@pytest.mark.parametrize("given, want", [("**b**", True), ("## t", True), ("- x", True), ("***", True), ("```", True), ("1. x", False), ("> q", False), ("a - b", False), (None, False), ("", False)])
def test_has_markup(spark, given, want):
    assert one(spark, given, markup.has_markup) is want


def test_kinds(spark):
    assert one(spark, "# t\n1. x\n> q\n`c` [a](b) ![c](d)\n|a|b|", markup.kinds) == ["title", "list", "inline_code", "quote", "link", "image", "table"]
    assert one(spark, "## a\n# b\n## c", markup.title_levels) == [1, 2]
    assert one(spark, None, markup.kinds) == []


@pytest.mark.parametrize(
    "given, want",
    [("a。b！c", ["a。", "b！", "c"]), ("!!", ["!", "!"]), ("。a", ["。", "a"]), (" 。 x?!y", [" 。", " x?", "!", "y"]), ("abc", ["abc"]), ("a?  ", ["a?"]), ("", []), ("x! \n y", ["x!", " \n y"]), (None, None)],
)
def test_sentences(spark, given, want):
    assert one(spark, given, text.sentences) == want


@pytest.mark.parametrize("given, want", [("中文中文a", "chinese"), ("中aaaa", "mixed"), ("hello", "non_chinese"), ("   ", "empty"), (None, "unknown")])
def test_language(spark, given, want):
    assert one(spark, given, text.language) == want


def test_special_ratio(spark):
    assert one(spark, "it's #1 “q” é中—x", text.special_ratio) == pytest.approx(4 / 16)
    assert one(spark, None, text.special_ratio) == 1.0
    assert one(spark, "", text.special_ratio) == 0.0


def test_statistics_of_nothing(spark):
    row = spark.createDataFrame([("",)], "t string").select(*[c.alias(n) for n, c in text.statistics(F.col("t")).items()]).first()
    assert row["char_count"] == 0 and row["sentence_count"] == 1 and row["char_diversity"] == 0


def test_first_transition(spark):
    assert one(spark, [-100, 0, 1, 1], spans.first_transition, "array<int>") == 2
    for labels in ([0, -100, 1], [0, 0], [1, 1], [], [0]):
        assert one(spark, labels, spans.first_transition, "array<int>") is None


def test_marks(spark):
    df = spark.createDataFrame([("ab[SEP]cd[SEP]", 9), ("abcd", 2), ("[SEP]x", 0)], "t string, b int")
    rows = df.select(spans.remove_marks(F.col("t")), spans.shifted(F.col("t"), F.col("b")), spans.insert_mark(F.col("t"), F.col("b"))).collect()
    assert [tuple(r)[:2] for r in rows] == [("abcd", 4), ("abcd", 2), ("x", 0)]
    assert rows[1][2] == "ab[SEP]cd"


def test_alignment(spark):
    df = spark.createDataFrame([(1, "[CLS]人a b", 2), (2, None, 1), (3, "x", None)], "id long, t string, b int")
    got = spans.aligned(df, "id", "t", "b").orderBy("pos").collect()
    assert [(r["token"], r["at"], r["token_label"]) for r in got] == [("[CLS]", 0, -100), ("人", 0, 0), ("a", 1, 0), ("b", 2, 1)]


@pytest.mark.parametrize("length, want", [(0, None), (200, 0), (201, 1), (500, 1), (501, 2), (10000, 4)])
def test_bins_are_right_closed(spark, length, want):
    assert one(spark, length, lambda c: maths.bin_of(c, [0.0, 200.0, 500.0, 1000.0, 2000.0, math.inf]), "int") == want


def test_decision(spark):
    from scriptorium.operators import detection

    rows = [(0.80, None), (0.805, None), (0.81, None), (0.5, None), (0.19, None), (0.2, None), (0.9, 3), (0.1, 3)]
    got = detection.decided(spark.createDataFrame(rows, "prob_ai double, boundary int")).collect()
    assert [r["kind"] for r in got] == ["ai", "ai", "ai", "human", "human", "human", "mixed", "human"]


def test_plan_rules(spark):
    df = spark.createDataFrame([(1, "对话体论文", None, None, None, "说明"), (None, None, None, None, "改写这段", "其他")], "plan_id long, topic string, genre string, writer_role string, prompt string, attribute string")
    a, b = planning.normalized(df).orderBy(F.col("plan_id").desc_nulls_last()).collect()
    assert (a["topic_domain"], a["prompt_type"], a["task_type"], a["model_family"], a["decoding_profile"]) == ("对话", "dialogue", "expository", "gpt", "medium")
    assert (b["topic_domain"], b["prompt_type"], b["task_type"], b["rewrite_type"]) == ("社会", "rewrite", "other", "paraphrase")
