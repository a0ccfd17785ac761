from __future__ import annotations

import json
import random
from collections import deque

from pyspark.sql import functions as F

from scriptorium.operators import integration, metrics, sampling
from scriptorium.sources import readers, sinks
from scriptorium.streaming import limiter, microbatch


def frame(spark, n=500):
    return spark.range(n).select(F.col("id"), (F.col("id") % 3).cast("int").alias("label"), F.when(F.col("id") % 7 == 0, None).otherwise(F.lit("s")).alias("source"))


def test_split_is_a_partition_with_exact_sizes(spark):
    rows = sampling.split(frame(spark), "id", ["label"], 0.3, 0.5).collect()
    assert sorted(r["id"] for r in rows) == list(range(500))
    for label in range(3):
        n = sum(r["label"] == label for r in rows)
        held = -(-n * 3 // 10)
        assert sum(r["label"] == label and r["split"] != "train" for r in rows) == held
        assert sum(r["label"] == label and r["split"] == "test" for r in rows) == -(-held // 2)


def test_split_of_an_empty_table(spark):
    assert sampling.split(frame(spark, 0), "id", ["label"], 0.3, 0.5).count() == 0
    assert sampling.sample_n(frame(spark, 0), "id", 5).count() == 0
    assert sampling.balanced(frame(spark, 0), "id", "label").count() == 0


def test_ranks_follow_the_hash_within_null_and_other_strata(spark):
    rows = sampling.ranked(frame(spark), "id", ["source"]).withColumn("h", sampling.hash_key("id")).collect()
    for s in (None, "s"):
        part = sorted((r for r in rows if r["source"] == s), key=lambda r: (r["h"], r["id"]))
        assert [r["rank"] for r in part] == list(range(1, len(part) + 1))


def test_sample_is_stable(spark):
    a = {r["id"] for r in sampling.sample_n(frame(spark), "id", 50).collect()}
    b = {r["id"] for r in sampling.sample_n(frame(spark).repartition(7), "id", 50).collect()}
    assert len(a) == 50 and a == b


def test_first_by_hash_keeps_the_first(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, None), (5, None)], "id long, text string").withColumn("text_hash", F.md5("text"))
    assert sorted(r["id"] for r in integration.first_by_hash(df, ["id"]).collect()) == [1, 2, 4]


def test_metrics_edges(spark):
    empty = spark.createDataFrame([], "pred int, label int, s double")
    assert metrics.confusion(empty).first()["f1"] == 0.0
    one = spark.createDataFrame([(1, 1, 0.5), (1, 1, 0.5)], "pred int, label int, s double")
    assert metrics.auc(one, "s").first()["auc"] is None
    tied = spark.createDataFrame([(1, 1, 0.5), (1, 0, 0.5)], "pred int, label int, s double")
    assert metrics.auc(tied, "s").first()["auc"] == 0.5


def simulated(events, limit, window):
    logs, out = {}, {}
    for i, s, c, t in sorted(events, key=lambda e: (e[3], e[0])):
        log = logs.setdefault((s, c), deque())
        while log and log[0] < t - window:
            log.popleft()
        out[i] = len(log) < limit
        if out[i]:
            log.append(t)
    return out


def test_limiter(spark):
    rng = random.Random(3)
    events = [(i, "detect", rng.choice("ab"), float(rng.randrange(600))) for i in range(400)] + [(400, "detect", "z", 0.0), (401, "detect", "z", 60.0), (402, "detect", "z", 60.5)]
    df = spark.createDataFrame(events, "id long, scope string, client string, ts double")
    got = {r["id"]: r["admitted"] for r in limiter.limited(df, {"detect": 1 + 4}, 60.0).collect()}
    assert got == simulated(events, 5, 60.0)
    assert all(r["admitted"] for r in limiter.limited(df, {"detect": 0}).collect())
    hits = limiter.limited(df.filter("client = 'z'"), {"detect": 1}).orderBy("id").collect()
    assert [r["admitted"] for r in hits] == [True, False, True]  # an entry of exactly 60 s ago still counts


def test_limiter_stream(spark, tmp_path):
    src = tmp_path / "in"
    events = [(i, "s", "a", float(i * 10)) for i in range(20)]
    df = spark.createDataFrame(events, "id long, scope string, client string, ts double")
    df.coalesce(1).write.parquet(str(src))
    stream = limiter.limited_stream(spark.readStream.schema(df.schema).parquet(str(src)), {"s": 3}, 60.0)
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["id"]: r["admitted"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == simulated(events, 3, 60.0)


def test_append_once_and_resume(spark, tmp_path):
    path, plan = str(tmp_path / "sink"), spark.range(6).withColumnRenamed("id", "plan_id")
    assert microbatch.unfinished(plan, path, "plan_id").count() == 6
    microbatch.append_once(plan.filter("plan_id < 3"), 0, path, "plan_id")
    microbatch.append_once(plan.filter("plan_id < 3"), 0, path, "plan_id")  # repeated after a crash
    microbatch.append_once(plan.filter("plan_id < 4"), 1, path, "plan_id")
    assert sorted(r["plan_id"] for r in spark.read.parquet(path).collect()) == [0, 1, 2, 3]
    assert sorted(r["plan_id"] for r in microbatch.unfinished(plan, path, "plan_id").collect()) == [4, 5]


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿text,label,other\n"x ""q""\ny",1,z\nb,,z\n', encoding="utf-8")
    rows = readers.csv(spark, str(tmp_path / "a.csv"), readers.LABELLED).collect()
    assert [tuple(r) for r in rows] == [('x "q"\ny', 1), ("b", None)]
    (tmp_path / "c2_1.json").write_text(json.dumps([{"text": "a", "boundary": 1}, {"text": "b"}]))
    (tmp_path / "c2_span_labels.json").write_text("[]")
    got = readers.globbed(spark, str(tmp_path / "c2*.json"), readers.HYBRID, skip="span_labels").collect()
    assert [(r["text"], r["boundary"]) for r in got] == [("a", 1), ("b", None)]
    (tmp_path / "l.json").write_text('{"text": "a", "label": 1}\nnot json\n')
    assert [r["_corrupt"] for r in readers.json_lines(spark, str(tmp_path / "l.json"), readers.LABELLED).collect()] == [None, "not json"]
    (tmp_path / "qa.txt").write_text(json.dumps({"question": "q", "human_answers": ["h"], "chatgpt_answers": ["c", "d"]}) + "\n")
    qa = readers.qa(spark, str(tmp_path / "qa.txt"), "baike")
    assert qa.columns == ["id", "question", "human_answers", "chatgpt_answers"]
    assert sorted((r["label"], r["text"]) for r in readers.qa_texts(qa).collect()) == [(0, "h"), (1, "c"), (1, "d")]
    (tmp_path / "t.txt").write_text("  a \n\n　b\n")
    assert [r["text"] for r in readers.lines(spark, str(tmp_path / "t.txt")).collect()] == ["a", "b"]
    (tmp_path / ".x.csv").write_text("")
    assert [p.rsplit("/", 1)[1] for p in readers.discovered(spark, str(tmp_path))] == ["a.csv", "c2_1.json", "c2_span_labels.json", "l.json"]
    found, missing = readers.tolerant({"a": lambda: readers.csv(spark, str(tmp_path / "a.csv"), readers.LABELLED), "b": lambda: spark.read.parquet(str(tmp_path / "none"))})
    assert list(found) == ["a"] and list(missing) == ["b"]
    assert readers.text_and_label(["ID", "Content", "标签"]) == ("Content", "标签")
    assert readers.blocks("One：\nurl: http://x\nkey：k\n\nTwo\nurl: y", {"Two": "Second"}) == [{"name": "one", "url": "http://x", "key": "k"}, {"name": "second", "url": "y"}]
    assert readers.newest(spark, str(tmp_path), r"c2.*\.json") == "c2_span_labels.json"


def test_generated_survives_failures(spark):
    def call(prompt):
        if prompt == "bad":
            raise RuntimeError
        return prompt.upper()

    df = spark.createDataFrame([("a",), ("bad",), (None,)], "prompt string")
    assert [r["result"] for r in readers.generated(df, call).collect()] == ["A", None, None]


def test_counts_rows_and_splits_plain_files(spark, tmp_path):
    (tmp_path / "n.csv").write_text("text,label\na,1\nb,0\n")
    assert readers.data_rows(spark, str(tmp_path / "n.csv")) == 2 and readers.data_rows(spark, str(tmp_path / "none.csv")) == 0
    (tmp_path / "h.csv").write_text("text,label\n")
    (tmp_path / "e.csv").write_text("")
    assert readers.data_rows(spark, str(tmp_path / "h.csv")) == 0 and readers.data_rows(spark, str(tmp_path / "e.csv")) == 0
    assert [tuple(r) for r in readers.csv(spark, str(tmp_path / "n.csv"), readers.LABELLED, line_feeds=False).collect()] == [("a", 1), ("b", 0)]


def test_questions_are_numbered_by_line(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.jsonl").write_text("".join(json.dumps({"question": f"{k}-{i}", "human_answers": []}) + "\n" for i in range(4)))
    rows = readers.qa(spark, str(tmp_path), "all").orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(12)) and {r["question"] for r in rows} == {f"{k}-{i}" for k in range(3) for i in range(4)}
    assert all(int(a["question"][2]) + 1 == int(b["question"][2]) for a, b in zip(rows, rows[1:]) if a["question"][0] == b["question"][0])


def test_routing_by_family():
    def busy(prompt, model):
        raise readers.Limited("429")

    calls, waits = [], []
    good = readers.Endpoint("good", ["m1", "m2"], lambda p, m: calls.append(m) or p + m, {"gpt": ["m2"]})
    bad = readers.Endpoint("bad", ["b"], busy, {"gpt": ["b"]})
    other = readers.Endpoint("other", ["o"], lambda p, m: m, {"qwen": ["o"]})
    route = readers.routed([good, bad, other], 3, waits.append)
    assert {route(f"p{i}", "gpt")[1:] for i in range(8)} == {("good", "m2")} and set(waits) == {6.0}
    assert route("p", "qwen") == ("o", "other", "o") and route("p", "none")[1] in {"good", "other"}
    assert readers.routed([bad], 3)("p", "gpt") == (None, "all_failed", "bad:429")
    assert readers.routed([good], 0)("p", "gpt") == (None, "all_failed", "exhausted")


def test_batches_until_a_target(recwarn):
    state = {"done": 0, "calls": 0}

    def batch():
        state["calls"] += 1
        if state["calls"] == 2:
            raise RuntimeError("lost")
        state["done"] += 3

    assert microbatch.until(batch, lambda: state["done"], 7) == 4 and state["done"] == 9 and len(recwarn) == 1
    assert microbatch.until(batch, lambda: 0, 1, most=2) == 2 and microbatch.until(batch, lambda: 5, 5) == 0


def test_medians_and_numbers_by_ranges(spark):
    from scriptorium.operators import ranges

    rng = random.Random(5)
    rows = [(g, rng.choice([0.0, 1.0, rng.random()])) for g in ("a", "b", None) for _ in range(rng.randrange(50, 80))] + [("c", None), ("d", 0.25)]
    got = {r["g"]: r["median"] for r in ranges.medians(spark.createDataFrame(rows, "g string, v double"), "v", ["g"]).collect()}
    import statistics

    assert got == {g: statistics.median([v for h, v in rows if h == g and v is not None]) for g in ("a", "b", "d", None)}
    ids = rng.sample(range(10_000), 200)
    numbered = ranges.numbered(spark.createDataFrame([(i,) for i in ids], "id long"), "id").collect()
    assert {r["id"]: r["n"] for r in numbered} == {i: n for n, i in enumerate(sorted(ids))}
    assert ranges.numbered(spark.createDataFrame([], "id long"), "id").count() == 0


def test_curves_of_scores_that_pile_up(spark):
    rng = random.Random(6)
    rows = [(min(1.0, max(0.0, rng.choice([0.0, 1.0]) + rng.gauss(0, 1e-6))), rng.randrange(2)) for _ in range(400)]
    got = metrics.roc(spark.createDataFrame(rows, "s double, label int"), "s").collect()
    pos, neg = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    want = {t: (round(sum(y for s, y in rows if s >= t) / pos, 6), round(sum(1 - y for s, y in rows if s >= t) / neg, 6)) for t in {s for s, _ in rows}}
    assert {r["threshold"]: (r["tpr"], r["fpr"]) for r in got} == want


def test_gate_in_blocks(spark):
    from scriptorium.operators import detection

    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(60, None), (61, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    a = sorted(map(tuple, detection.gated(df, df, "vec_id", "embedding", 0.8).collect()))
    b = sorted(map(tuple, detection.gated(df, df, "vec_id", "embedding", 0.8, block=7).collect()))
    assert a == b and [r[0] for r in a] == list(range(60)) and {r[3] for r in a} == {True, False}
    assert detection.gated(df.limit(0), df, "vec_id", "embedding").count() == 0


def test_shared_folder_and_release(spark):
    from scriptorium import session

    t = session.stage(spark.range(5), "x")
    path = t.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    import os

    assert os.path.isdir(path) and t.count() == 5
    session.release(t)
    assert not os.path.isdir(path)


def test_fixpoint_of_deep_nesting(spark):
    from scriptorium.functions import markup

    deep = "> " * 12 + "- " * 5 + "x"
    row = spark.createDataFrame([(deep, None)], "a string, b string").select(markup.strip_markup_fixpoint(F.col("a")).alias("a"), markup.strip_markup_fixpoint(F.col("b")).alias("b")).first()
    assert row["a"] == "x" and row["b"] is None


def test_failover():
    def broken(_):
        raise RuntimeError

    assert readers.with_failover([broken, lambda p: p + "!"], 3)("a") == "a!"
    assert readers.with_failover([broken], 2)("a") is None


def test_stream_to_a_sink(spark, tmp_path):
    import time

    spark.range(10).withColumnRenamed("id", "plan_id").write.parquet(str(tmp_path / "in"))
    monitor = microbatch.Monitor(10)
    spark.streams.addListener(monitor)
    q = microbatch.start(spark.readStream.schema("plan_id long").parquet(str(tmp_path / "in")), str(tmp_path / "out"), "plan_id", str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
    for _ in range(50):
        if monitor.done:
            break
        time.sleep(0.1)
    spark.streams.removeListener(monitor)
    assert monitor.done


def test_printed(spark):
    row = spark.createDataFrame([(1234567, 0.5, None)], "n long, x double, s string")
    assert sinks.printed(row, 12).first()["line"] == "1,234,567   0.5000      -"
    assert len(sinks.stamped(row).first()["generated_at"]) == 19


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", True), (2, None, False)], "id int, text string, success boolean")
    sinks.append(rows, str(tmp_path / "c"))
    sinks.append(rows, str(tmp_path / "c"))
    assert readers.csv(spark, str(tmp_path / "c"), rows.schema).count() == 4
    assert json.loads(sinks.report(rows.filter("id = 2")).first()["report"]) == {"id": 2, "text": None, "success": False}
    sinks.split_tables(rows.withColumn("split", F.lit("train")), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_graph_of_a_triangle(spark):
    from scriptorium.operators import graph

    e = graph.edges(spark.createDataFrame([(1, "a b c"), (2, None), (3, "")], "id long, t string"), "id", "t")
    row = graph.statistics(e, "id").first()
    assert (row["nodes"], row["edges"], row["density"], row["clustering"]) == (3, 3, 1.0, 1.0)
    assert graph.path_lengths(e, "id").first()["avg_path_length"] == 1.0


def test_paths_of_any_length_and_words_of_any_length(spark):
    from scriptorium.operators import graph

    chain = spark.createDataFrame([(1, f"n{i:02}", f"n{i + 1:02}") for i in range(9)], "id long, a string, b string")
    mean = sum(j - i for i in range(10) for j in range(i + 1, 10)) / 45
    assert graph.path_lengths(chain, "id").first()["avg_path_length"] == round(mean, 6)
    docs = spark.createDataFrame([(1, "这是一个没有空格而且很长的句子，abcdefghijklmnopq short"), (2, "x" * 60 + " y"), (3, "lone")], "id long, t string")
    rows = {r["id"]: (r["nodes"], r["edges"]) for r in graph.text_statistics(docs, "id", "t").collect()}
    assert rows == {1: (3, 3), 2: (2, 0), 3: (1, 0)}
    docs = spark.createDataFrame([(k, " ".join(f"{w * w * 7 % 61:04}" for w in range(k * 20))) for k in range(1, 5)] + [(9, None)], "id long, t string")
    edge = graph.edges(docs, "id", "t")
    assert sorted(graph.text_path_lengths(docs, "id", "t").collect()) == sorted(graph.path_lengths(edge, "id").collect())
    assert sorted(graph.text_statistics(docs, "id", "t").collect()) == sorted(graph.statistics(edge, "id").collect())


def test_distances_against_searches_from_each_word(monkeypatch):
    import random

    import numpy as np

    from scriptorium.operators import graph

    monkeypatch.setattr(graph, "SOURCES", 7)
    rng = random.Random(3)
    pairs = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(50)})
    want = {}
    for s in {x for p in pairs for x in p}:
        seen, last, d = {s}, {s}, 0
        while last:
            last, d = {y for p in pairs for x, y in (p, p[::-1]) if x in last} - seen, d + 1
            seen |= last
            want[d] = want.get(d, 0) + len(last)
    a, b = np.array(pairs).T
    assert dict(graph._distances(graph._beside(a, b, 60))) == {d: n for d, n in want.items() if n}
