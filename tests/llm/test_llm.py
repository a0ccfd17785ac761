from __future__ import annotations

import base64
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import bpe, content, cutoff, garble, mixing, nearness, overlap, packing, splitting

SYLLABLES = [chr(c) for c in range(0x4E00, 0x4E00 + 900)]


def words(rng, n):
    return "".join(rng.choice(SYLLABLES) for _ in range(n))


def edited(rng, t, k):
    out = list(t)
    for _ in range(k):
        i = rng.randrange(len(out))
        out[i : i + rng.choice((0, 1, 1))] = [rng.choice(SYLLABLES)] * rng.choice((0, 1))
    return "".join(out)


def run_set(t):
    import unicodedata

    n = "".join(c for c in (t or "").lower() if unicodedata.category(c)[0] in "LN")
    return {n[i : i + 5] for i in range(len(n) - 4)}


def same(a, b):
    x, y = run_set(a), run_set(b)
    return bool(x and y) and len(x & y) >= 0.6 * len(x | y)


def collection(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        t = words(rng, rng.choice((12, 30, 60, 150, 400)))
        rows.append(t)
        for _ in range(rng.choice((0, 1, 2))):
            kind = rng.randrange(5)
            k = max(1, len(t) // 30)
            if kind == 0:
                rows.append(t)
            elif kind == 1:
                rows.append(edited(rng, t, k))
            elif kind == 2:
                rows.append(t[len(t) // 2 :] + "。" + t[: len(t) // 2])
            elif kind == 3:
                rows.append(t + words(rng, len(t) // 3))
            else:
                rows.append("，".join(t[i : i + 7] for i in range(0, len(t), 7)))
    rows += [None, "", "  ", "abc", "abcd"] * 2 + ["copy of a copy, copied over and over"] * 20
    return rows


def frame(spark, texts, start=1):
    return spark.createDataFrame([(i + start, t) for i, t in enumerate(texts)], "id long, text string").repartition(3)


# --- near-duplicates


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_against_brute_force(spark, seed):
    texts = collection(seed)
    want = {(i + 1, j + 1) for i in range(len(texts)) for j in range(i + 1, len(texts)) if same(texts[i], texts[j])}
    got = [tuple(r) for r in nearness.found(frame(spark, texts)).collect()]
    assert len(got) == len(set(got))
    assert set(got) <= want and len(want - set(got)) <= 0.01 * len(want)


def test_groups_are_the_components(spark):
    texts = collection(5)
    pairs = [(i + 1, j + 1) for i in range(len(texts)) for j in range(i + 1, len(texts)) if same(texts[i], texts[j])]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    degree = Counter()
    for a, b in pairs:
        degree.update((a, b))
        a, b = sorted((find(a), find(b)))
        root[b] = a
    with_content = {i + 1 for i, t in enumerate(texts) if run_set(t)}
    rows = nearness.groups(frame(spark, texts)).collect()
    size = Counter(find(i) for i in with_content)
    assert {r["id"] for r in rows} == with_content and len(rows) == len(with_content)
    assert all(r["group_id"] == find(r["id"]) and r["group_size"] == size[r["group_id"]] for r in rows)
    rows = nearness.linked(frame(spark, texts)).collect()
    assert {r["id"] for r in rows} == with_content and all(r["n_links"] == degree[r["id"]] for r in rows)


def test_groups_of_many_near_copies_take_linear_work(spark, monkeypatch):
    rng, compared, m = random.Random(11), [], 5000
    base = words(rng, 300)
    copies = [base[:k] + rng.choice(SYLLABLES) + base[k + 1 :] for k in (rng.randrange(300) for _ in range(m))]
    monkeypatch.setattr(content, "verify", lambda pairs, least, verify=content.verify: compared.append(pairs.count()) or verify(pairs, least))
    rows = nearness.groups(frame(spark, copies + [words(rng, 300) for _ in range(50)])).collect()
    assert Counter(r["group_id"] for r in rows).most_common(1) == [(1, m)] and len(rows) == m + 50
    assert sum(compared) < 60 * m  # all pairs would be 2,500 for each


def test_near_duplicates_of_nothing(spark):
    assert nearness.found(frame(spark, [None, "", "abc"])).count() == 0
    empty = spark.createDataFrame([], "id long, text string, cls int, prefix int, content string")
    assert nearness.found(empty).count() == 0 and nearness.groups(empty).count() == 0


def test_extra_columns_and_null_or_repeated_ids(spark):
    t = "一段足够长的文字，用来比较相同的内容。"
    df = spark.createDataFrame([(1, t, "x", 1), (1, t, "x", 1), (2, t, "y", 2), (None, t, "z", 3)], "id long, text string, content string, cls int")
    assert [tuple(r) for r in nearness.found(df).collect()] == [(1, 2)]


def test_prefixes_shorten_as_far_as_the_recall_needs(spark, monkeypatch):
    rng, depths = random.Random(12), []
    monkeypatch.setattr(nearness.Forest, "nodes", lambda self, d, nodes=nearness.Forest.nodes: depths.append(d) or nodes(self, d))
    bases = [words(rng, 200) for _ in range(400)]
    alike = bases + [t[:100] + "改" + t[101:] for t in bases]  # similarity 0.95
    assert nearness.found(frame(spark, alike), recall=0.98).count() == 400
    near, depths[:] = list(depths), []
    nearness.found(frame(spark, bases + [t[:125] for t in bases]), recall=0.98).count()  # similarity 0.62
    assert near[0] == depths[0] == nearness.floor_depth(0.6, 48, 0.99) + nearness.BELOW
    assert near == sorted(near, reverse=True) and near[-1] > depths[-1] == nearness.floor_depth(0.6, 48, 0.99)


def test_neighbours_are_found_across_the_ranges(spark):
    rng = random.Random(13)
    rows = [(rng.randrange(6), rng.choice([0, 1, 256, -1, 1 << 40, rng.getrandbits(62)]), i) for i in range(300)] + [(7, 5, 900)]
    forest = object.__new__(nearness.Forest)
    forest.floor = 4
    for n in (1, 40):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        got = {r["cls"]: r["depth"] for r in forest._sorted(spark.createDataFrame(rows, "root long, deep long, cls long")).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")

        def shared(x, y):
            return next((k for k in range(8) if (x ^ y) & (255 << (56 - 8 * k))), 8)

        want = {c: 4 + max(shared(d & (2**64 - 1), e & (2**64 - 1)) for q, e, k in rows if q == r and k != c) for r, d, c in rows if sum(q == r for q, *_ in rows) > 1}
        assert got == want


def test_the_floor_lies_deeper_with_more_trees_and_less_recall():
    assert nearness.floor_depth(0.6, 48, 0.5) > nearness.floor_depth(0.6, 48, 0.99) >= 2
    assert nearness.floor_depth(0.6, 96, 0.99) > nearness.floor_depth(0.6, 24, 0.99)


# --- overlaps


@pytest.mark.parametrize("seed", [3, 4])
def test_overlaps_against_brute_force(spark, seed):
    texts = collection(seed, 80)
    random.Random(seed).shuffle(texts)
    half = len(texts) // 2
    train, evaluation = texts[:half], texts[half:]
    want = {(i + 1, j + 1001) for i, a in enumerate(train) for j, b in enumerate(evaluation) if same(a, b)}
    got = [(r["train_id"], r["eval_id"]) for r in overlap.found(frame(spark, train), frame(spark, evaluation, 1001)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_overlaps_with_edits_at_ends_and_across_borders(spark):
    rng = random.Random(9)
    train, evaluation = [], []
    for k in range(60):
        n, first = 32 if k < 20 else rng.randrange(20, 120), 0x4E00 + 150 * k
        t = [chr(first + i) for i in range(n)]
        evaluation.append("".join(t))
        if k < 20:  # the ends missing and a character replaced
            t[10 + k % 12] = "字"
            t = t[1:-1]
        for _ in range(0 if k < 20 else rng.randrange(1, 2 + n // 16)):
            at = rng.choice([0, len(t) - 1, rng.randrange(len(t))])
            t[at : at + rng.randrange(1, 3)] = rng.choice([[], ["字"], ["另", "外"]])
        train.append("".join(t))
    want = {(i + 1, j + 1001) for i, a in enumerate(train) for j, b in enumerate(evaluation) if same(a, b)}
    got = {(r["train_id"], r["eval_id"]) for r in overlap.found(frame(spark, train), frame(spark, evaluation, 1001)).collect()}
    assert got == want and len(want) > 30


def test_overlap_report_counts_rows(spark):
    t = "这是一段既在训练集里也在测试集里的文字。"
    train = frame(spark, [t, t, None])
    ev = spark.createDataFrame([(11, t, "val", "s"), (12, "别的完全不同的内容在这里出现", "val", "s"), (13, None, "val", None)], "id long, text string, split string, source string")
    got = {(r["split"], r["source"]): (r["n_rows"], r["n_overlapping"], r["n_exact"], r["n_pairs"]) for r in overlap.report(train, ev).collect()}
    assert got == {("val", "s"): (2, 1, 1, 2), ("val", None): (1, 0, 0, 0)}


def test_overlap_with_an_empty_side(spark):
    empty = spark.createDataFrame([], "id long, text string")
    assert overlap.found(empty, frame(spark, collection(1, 5))).count() == 0
    assert overlap.found(frame(spark, collection(1, 5)), empty).count() == 0


def test_alignment_scores():
    x = np.arange(50, dtype=np.uint32)
    y = np.concatenate([np.arange(900, 910, dtype=np.uint32), x[:20], np.array([7777], np.uint32), x[20:]])
    assert overlap.aligned([(x, x, 0), (x, y, 10), (x, y + 1000, 0)]).tolist() == [50, 49, 0]


def test_alignment_of_long_texts_goes_by_stretches():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3000, 50_000).astype(np.uint32)
    moved = np.concatenate([np.full(7000, 99_999, np.uint32), x])
    assert overlap.aligned([(x, x, 0), (x, moved, 7000), (moved, x, -7000), (x, moved, 20_000), (x[:0], x, 0)]).tolist()[:3] == [50_000] * 3
    assert overlap.aligned([(x, x[:5], 0), (x[:5], x, 0), (x[:5], x[100:], 3)]).tolist()[:2] == [5, 5]


def test_a_phrase_shared_by_all_texts_and_a_crowded_sketch(spark, monkeypatch):
    rng, shared = random.Random(31), words(random.Random(32), 40)
    texts = [shared + words(rng, 120) for _ in range(300)]
    train, evaluation = texts[:200] + [shared * 30], texts[190:] + [shared * 25]
    want = {(i + 1, j + 1001) for i, a in enumerate(train) for j, b in enumerate(evaluation) if same(a, b)}
    monkeypatch.setattr(overlap, "BUCKETS_MOST", overlap.PIECE // 4)
    monkeypatch.setattr(overlap, "PIECE", overlap.PIECE // 4)
    got = {(r["train_id"], r["eval_id"]) for r in overlap.found(frame(spark, train), frame(spark, evaluation, 1001)).collect()}
    assert got == want and len(want) == 11


def test_many_diagonals_go_to_the_exact_check(spark, monkeypatch):
    monkeypatch.setattr(overlap, "DIAGONALS", 0)
    texts = collection(3, 30)
    want = {(i + 1, j + 1001) for i, a in enumerate(texts) for j, b in enumerate(texts) if same(a, b)}
    assert {(r["train_id"], r["eval_id"]) for r in overlap.found(frame(spark, texts), frame(spark, texts, 1001)).collect()} == want


# --- encoding


def naive(ranks, piece):
    parts = [bytes([b]) for b in piece]
    while True:
        best = min(((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 30, 0))
        if best[0] == 1 << 30:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_encoding_against_brute_force():
    import regex

    e = bpe.Encoder.of(bpe.VOCABULARY)
    rng = random.Random(9)
    alphabet = "abcdefgh  \n\n'sé中文標點，。！0123٣😀‍　"
    texts = [None, "", " ", "\n\n \n", "aaaaaaaa" * 9] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 90))) for _ in range(120)]
    ids, at = e.encode(texts)
    for k, t in enumerate(texts):
        want = [i for w in regex.findall(bpe.PATTERN, t or "") for i in naive(e.ranks, w.encode())]
        assert ids[at[k] : at[k + 1]].tolist() == want


def test_round_trip_and_long_texts(spark):
    text = "长文字 with words, " * 4000 + "x" * 50_000
    df = spark.createDataFrame([(1, text, "e"), (2, None, "e"), (3, "", "e"), (3, "", "e"), (None, "a", "e")], "doc_id long, text string, ids string")
    rows = bpe.encode(df).collect()
    with open(bpe.VOCABULARY, "rb") as f:
        back = {int(r): base64.b64decode(t) for t, r in (x.split() for x in f)}
    got = {r["doc_id"]: r["ids"] for r in rows}
    assert len(rows) == 5 and got[2] == [] and got[3] == [] and len(got[None]) == 1
    assert b"".join(back[i] for i in got[1]).decode() == text
    texts = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(df)).collect()}
    assert texts == {1: text, 2: "", 3: "", None: "a"}
    wrong = spark.createDataFrame([(1, None), (2, [10**6]), (3, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in bpe.decode(wrong).collect()} == {1: None, 2: None, 3: ""}
    counts = {r["doc_id"]: r["n_tokens"] for r in bpe.count(df).collect()}
    assert counts[1] == len(got[1]) and counts[2] == 0


# --- packing


def test_packing_fills_and_never_overflows(spark):
    rng = random.Random(2)
    texts = [" ".join(["word"] * int(min(5000, rng.lognormvariate(6, 0.8)))) for _ in range(800)] + [None, "", "x"] + [" ".join(["same"] * 700)] * 400
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, container int")
    got, about = packing.pack(df)
    rows = got.collect()
    sizes = {r["doc_id"]: r["n_tokens"] for r in bpe.count(df).collect()}
    load, of = Counter(), Counter()
    for r in rows:
        of[r["doc_id"]] += r["n_tokens"]
        if r["container"] is not None:
            load[r["container"]] += r["n_tokens"]
        else:
            assert r["n_tokens"] == 0
    assert of == Counter({k: v for k, v in sizes.items()}) and max(load.values()) <= 2048
    pieces = Counter(r["doc_id"] for r in rows)
    assert all(pieces[k] == max(1, -(-v // 2048)) for k, v in sizes.items())
    a = about.first()
    assert a["containers"] == len(load) and a["lower_bound"] <= len(load) <= 1.03 * a["lower_bound"] + 1


def test_the_audit_notices_what_is_wrong(spark):
    packed = spark.createDataFrame([(1, 0, 2048, 0), (1, 1, 7, 1), (2, 0, 2042, 1), (3, 1, 5, 2), (4, 0, 0, None), (5, 0, 9, 3), (5, 1, 9, 3)], "doc_id long, piece int, n_tokens long, container long")
    got = {r["doc_id"]: (r["in_order"], r["divided_right"], r["fits"]) for r in packing.audit(packed).collect()}
    assert got == {1: (True, True, False), 2: (True, True, False), 3: (False, True, True), 4: (True, True, True), 5: (True, False, True)}


def test_packing_of_nothing(spark):
    got, about = packing.pack(spark.createDataFrame([], "doc_id long, text string"))
    assert got.count() == 0 and about.first()["containers"] == 0


# --- mixing


def test_mix_reaches_the_shares(spark):
    rng = random.Random(4)
    rows = [(i, "字" * rng.randrange(50, 150), rng.choice(["a"] * 6 + ["b"] * 3 + ["c", None, "d"])) for i in range(3000)] + [(3000, None, "a"), (3001, "", "b")]
    docs = spark.createDataFrame(rows, "row_id long, text string, source string")
    weights = spark.createDataFrame([("a", 0.3, 1), ("b", 0.3, 2), ("c", 0.4, 4), ("z", 0.0, 1)], "source string, target_share double, max_repeats int")
    mixed, shares = mixing.mix(docs, weights, total=mixing.reachable(docs, weights))
    got = {r["source"]: r for r in shares.collect()}
    assert all(r["shortfall"] == 0 for r in got.values())
    assert all(abs(r["actual_share"] - r["target_share"]) < 0.01 for r in got.values()) and len(got) == 3
    uses = Counter(r["row_id"] for r in mixed.collect())
    source = {i: s for i, _, s in rows}
    assert all(n <= {"a": 1, "b": 2, "c": 4}[source[i]] for i, n in uses.items())
    assert all(r["epochs_used"] <= r["max_repeats"] for r in got.values())


def test_mix_reports_what_runs_out(spark):
    docs = spark.createDataFrame([(1, "x" * 100, "a"), (2, "y" * 10, "b")], "row_id long, text string, source string")
    weights = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    got = {r["source"]: (r["used"], r["epochs_used"]) for r in mixing.mix(docs, weights, total=200)[1].collect()}
    assert got == {"a": (100, 1), "b": (20, 2)}


def test_a_source_without_records_does_not_empty_the_mix(spark):
    docs = spark.createDataFrame([(i, "x" * 10, "ab"[i % 2]) for i in range(400)], "row_id long, text string, source string")
    weights = spark.createDataFrame([("a", 0.25, 3), ("b", 0.25, 3), ("none", 0.5, 3)], "source string, target_share double, max_repeats int")
    mixed, shares = mixing.mix(docs, weights)
    assert {r["source"]: (r["used"], r["shortfall"], r["actual_share"]) for r in shares.collect()} == {"a": (1000, 0, 0.5), "b": (1000, 0, 0.5), "none": (0, 2000, 0.0)}
    assert mixed.count() == 200 and mixing.reachable(docs, weights) == 0


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], "row_id long, text string, source string")
    weights = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    mixed, shares = mixing.mix(docs, weights)
    assert mixed.count() == 0 and shares.first()["used"] == 0


# --- splitting


def test_pieces_cover_overlap_and_fit(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["字", "词", "。", "，", "\n", "\n\n", " ", "word ", "é", "👩‍🌾", "\r\n"]) for _ in range(rng.randrange(900, 6000))) for _ in range(12)] + ["a" * 9001, "短", None, "", "x" * 2000, "x" * 2001]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "row_id long, text string, piece int")
    by: dict[int, list] = {}
    for r in splitting.split(df).orderBy("row_id", "piece").collect():
        by.setdefault(r["row_id"], []).append(r)
    assert set(by) == {i for i, t in enumerate(texts) if t and len(t) > 2000}
    for i, pieces in by.items():
        t, end = texts[i], 0
        assert [p["piece"] for p in pieces] == list(range(pieces[0]["n_pieces"]))
        for p in pieces:
            assert p["piece_text"] == t[p["start"] : p["end"]] and 0 < len(p["piece_text"]) <= 2000
            assert p["core"] == end < p["end"] and max(0, end - 200) <= p["start"] <= end
            assert all(splitting._inside_character(t, q) for q in range(max(1, end - 200), p["start"]))
            end = p["end"]
        assert end == len(t)


def test_cuts_prefer_strong_boundaries():
    t = "句子。" * 300 + "\n\n" + "句子。" * 350
    assert [b for _, b in splitting.cuts(t, 1800)] == ["start", "paragraph"]
    assert splitting.cuts("x" * 100, 60) == [(0, "start"), (50, "character")]
    assert all(not t[at].startswith("́") for t in ["é" * 80] for at, _ in splitting.cuts(t, 50) if at)


def test_a_boundary_outside_the_middle_half_comes_before_a_cut_inside_a_word():
    assert splitting.cuts("a" * 500 + " " + "b" * 1600, 1800) == [(0, "start"), (501, "word")]
    t = "c" * 1790 + "。" + "d" * 4000
    assert splitting.cuts(t, 1800)[1] == (1791, "sentence")
    assert splitting.cuts("e" * 100 + " " + "f" * 2000, 1800) == [(0, "start"), (1050, "character")]  # the space would leave 2000


def test_pieces_do_not_begin_inside_a_character(spark):
    t = "e\u0301" * 2600
    rows = splitting.split(spark.createDataFrame([(1, t)], "row_id long, text string"), overlap=201).collect()
    assert len(rows) > 2 and not any(r["piece_text"].startswith("\u0301") for r in rows) and all(len(r["piece_text"]) <= 2000 for r in rows)
    again = splitting.round_trip(splitting.split(spark.createDataFrame([(1, t)], "row_id long, text string"), overlap=201), overlap=201).first()
    assert (again["in_order"], again["fits"], again["overlaps"], again["parted"]) == (True, True, True, 0)


def test_round_trip_notices_what_is_wrong(spark):
    pieces = splitting.split(spark.createDataFrame([(i, "词。" * 2000) for i in range(4)], "row_id long, text string"))
    wrong = pieces.withColumn("core", F.when(F.expr("row_id = 1 and piece = 1"), F.col("core") + 1).otherwise(F.col("core"))).filter("not (row_id = 2 and piece = 1)")
    got = {r["row_id"]: r for r in splitting.round_trip(wrong).collect()}
    assert [got[i]["in_order"] for i in range(4)] == [True, False, False, True] and len({got[i]["text_hash"] for i in range(4)}) == 3


# --- garbled text


CLEAN = [
    "那年第二天一早，上园老街下了69天雨，祖辈留下的泉眼全泡在水里，果农也没有办法。",
    "研究员最怕的不是朝南的候车亭，而是铁关渔港的唱腔没人愿意改造。换句话说，把可持续的时间与教案放在一起验证。",
    "Où se trouve la clé étroite de la forêt abîmée ? L’été, on a gardé la théière près de la bibliothèque.",
    "Die kühle Säge wurde für 49 Tage geschlossen, während die Übung offen blieb. Später fand man eine Tür.",
    "Говорят, что паром и сарай близ деревни видели много раз, но пустой след пропал за рекой.",
    "A IRMÃ pequena abriu às 9 horas, e a AVELÃ não. Não há SEÇÃO mais úmida do que a REGIÃO número 7.",
]


@pytest.fixture(scope="module")
def model():
    counts = Counter("".join(CLEAN[:2]) * 8000 + "".join(CLEAN[2:]) * 200)  # mostly Chinese
    seen = Counter()
    for t, n in [("".join(CLEAN[:2]), 8000), ("".join(CLEAN[2:]), 200)]:
        data = np.array([ord(c) for c in t], dtype=np.uint32)
        for key in (garble.before(data).astype(int) * garble.SHIFT + data).tolist():
            seen[key] += n
    return garble.Model(dict(seen) | {ord(c): 0 for t in CLEAN for _, a, b, n, _ in garble.PAIRS for c in garble.damage(t, a, b, n) if c not in counts})


@pytest.mark.parametrize("was, as_, times", [("utf-8", "cp1252", 1), ("utf-8", "latin-1", 1), ("utf-8", "mac_roman", 1), ("utf-8", "cp1252", 2), ("gb18030", "cp1252", 1)])
def test_damage_is_found_and_undone(model, was, as_, times):
    t = CLEAN[0]
    bad = garble.damage(t, was, as_, times)
    spans = garble.label(model, ["完整。" + bad, t])
    assert spans[1] == [] and spans[0]
    out, last = [], 0
    whole = "完整。" + bad
    for a, b, _, restored, _ in spans[0]:
        out += [whole[last:a], restored]
        last = b
    assert "".join(out) + whole[last:] == "完整。" + t


@pytest.mark.parametrize("t", CLEAN + ["", "ascii only", "附注：字母«â»与«Ã»在第242页有说明。", "👩‍🌾 ok​", "<b>x</b> &amp; **y**"])
def test_correct_text_is_no_case(model, t):
    assert garble.label(model, [t]) == [[]]


def test_garbled_documents_on_spark(spark):
    rows = [(i, t, "n") for i, t in enumerate(CLEAN * 30)] + [(900, garble.damage(CLEAN[1], "utf-8", "gb18030", 1), "n"), (901, None, "n"), (902, "", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, restored string")
    got = garble.repair(df).collect()
    assert [r["doc_id"] for r in got] == [900]
    assert garble.repair(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_transitions_are_counted(spark):
    rows = [(i, t) for i, t in enumerate(CLEAN * 40)] + [(1000 + i, "完整。" + garble.damage(CLEAN[i % 2], "utf-8", "cp1252", 1)) for i in range(30)]
    model = garble.train(spark.createDataFrame(rows, "doc_id long, text string"))
    own = next(k for k, p in enumerate(garble.PAIRS) if p[0] == "utf-8>cp1252")
    assert model.enter.argmax() == own and (np.delete(model.enter, own) < model.enter[own] - 2).all()
    assert [len(x) for x in garble.label(model, [rows[0][1], rows[-1][1]])] == [0, 1]


def test_long_texts_are_cut_into_stretches_and_labelled_whole(model, monkeypatch):
    monkeypatch.setattr(garble, "STRETCH", 100)
    bad = garble.damage(CLEAN[0], "utf-8", "cp1252", 1)
    assert [(a, b, r) for a, b, _, r, _ in garble.label(model, ["完整。" + bad * 9])[0]] == [(3, 3 + 9 * len(bad), CLEAN[0] * 9)]


def test_cyrillic_is_not_taken_for_chinese_read_by_single_bytes(spark):
    russian = [(i, f"Почему старый причал у деревни важнее, чем сундук номер {i}? Говорят, что берег и мост видели много раз.") for i in range(60)]
    df = spark.createDataFrame(russian + [(100 + i, t) for i, t in enumerate(CLEAN[:2] * 100)] + [(900, garble.damage(CLEAN[1], "gb18030", "cp1251", 1))], "doc_id long, text string")
    assert [r["doc_id"] for r in garble.repair(df).collect()] == [900]


# --- cut texts


LEXICON = [words(random.Random(k), 2) for k in range(150)]


def phrase(rng, n):
    return "".join(rng.choice(LEXICON) for _ in range(n))


def sentence(rng):
    return phrase(rng, rng.randrange(3, 7)) + "，" + phrase(rng, rng.randrange(3, 6)) + "的" + rng.choice(["办法", "证明", "来历", "损耗"]) + "。"


def test_limits_are_found_in_characters_and_bytes():
    rng = np.random.default_rng(3)
    lengths = np.exp(rng.normal(6, 0.6, 4000)).astype(int)
    cut = np.where((rng.random(4000) < 0.8) & (lengths > 500), 500, lengths)
    values, counts = np.unique(cut, return_counts=True)
    found = cutoff.find_limits(values, counts, 1)
    assert [f[0] for f in found] == [500] and found[0][2] < 0.05 * found[0][1]
    values, counts = np.unique(lengths, return_counts=True)
    assert cutoff.find_limits(values, counts, 1) == []
    mu, sigma = cutoff.censored_fit(np.log(np.maximum(cut, 1)), np.ones(4000), cut == 500)
    assert abs(mu - 6) < 0.15 and abs(sigma - 0.6) < 0.15


def test_copies_of_a_text_are_sampled_one_by_one(spark):
    rng = random.Random(8)
    copy = sentence(rng) * 3
    rows = [(i, "s", copy if i % 3 == 0 else sentence(rng) + sentence(rng)) for i in range(1500)] + [(0, "s", copy)] * 500
    got = cutoff.drawn(spark.createDataFrame(rows, "key long, source string, text string"), 300, len(rows)).collect()
    assert 60 < sum(r["text"] == copy for r in got) < 140 and len(got) == 300
    assert cutoff.drawn(spark.createDataFrame(rows[:0], "key long, source string, text string"), 300, 0).count() == 0


def test_what_is_appended_makes_no_limits_of_its_own(spark):
    rng, rows = random.Random(21), []
    for i in range(1500):
        t = "".join(sentence(rng) for _ in range(rng.randrange(4, 30)))
        mark = rng.choice(["", "…", "...", "[更多]", "……阅读全文"])
        rows.append((i, t[:300] + mark if len(t) > 300 else t, "s"))
        rows.append((i, t[: 300 - len(mark)] + mark if len(t) > 300 else t, "within"))
    found = cutoff.detect(spark.createDataFrame(rows, "row_id long, text string, source string"))[1].collect()
    assert sorted((r["source"], r["measure"], r["length_limit"]) for r in found) == [("s", "core_chars", 300), ("within", "chars", 300)]


def test_real_cuts_teach_the_model_by_their_posterior():
    rows = cutoff.examples("一段在限制处断开的文字没有结", 0.9, 1)
    assert rows[0][1:] == (0.9, False) and cutoff.examples("完整。", 0.0, 1)[0][1:] == (0.0, True)


def test_all_limits_of_a_source_are_found():
    lengths = np.exp(np.random.default_rng(3).normal(6, 0.6, 4000)).astype(int)
    spikes = list(range(200, 1400, 100))
    values, counts = np.unique(np.concatenate([lengths, np.repeat(spikes, 200)]), return_counts=True)
    assert sorted(f[0] for f in cutoff.find_limits(values, counts, 1)) == spikes


def test_cut_texts_held_out(spark):
    rng = random.Random(6)
    rows, truth = [], set()
    for i in range(1200):
        t = "".join(sentence(rng) for _ in range(rng.randrange(4, 20)))
        kind = rng.random()
        if i % 3 == 0 and len(t) > 300:
            t = t[:300]
        elif kind < 0.05:
            t = t[: rng.randrange(60, len(t))]
        elif kind < 0.1:
            t += "\n——编辑，记于" + words(rng, 3)
        if not t.endswith("。") and "——" not in t:
            truth.add(i)
        rows.append((i, t, "abc"[i % 3], None))
    rows += [(5000, None, "a", 1), (5001, "  ", "a", 1), (5002, "完整的句子在这里。", None, 999)]
    df = spark.createDataFrame(rows, "row_id long, text string, source string, length int")
    judged, found = cutoff.detect(df)
    got = {r["row_id"] for r in judged.filter("cut").collect()}
    assert len(got & truth) >= 0.95 * len(truth) and len(got - truth) <= 0.02 * len(got)
    assert ("a", "core_chars", 300) in {(r["source"], r["measure"], r["length_limit"]) for r in found.collect()}
    shares = {r["source"]: r for r in cutoff.report(df).collect()}
    assert shares[None]["n_texts"] == 1 and shares[None]["n_cut"] == 0


def test_cut_texts_of_nothing(spark):
    judged, found = cutoff.detect(spark.createDataFrame([], "row_id long, text string, source string"))
    assert judged.count() == 0 and found.count() == 0


def test_content_is_letters_and_digits(spark):
    df = spark.createDataFrame([("Ab，1 é́中₂!",)], "t string")
    assert df.select(content.content("t")).first()[0] == "ab1é中₂"
    assert F is not None
