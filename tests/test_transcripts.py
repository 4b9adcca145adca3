"""Turns from displaced lines, clean text, speech runs, paths, zips, decoding and offsets: small cases with known answers."""

import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from talespan.operators import frames, graph, signals, transcripts, words
from talespan.runtime import ship

TAGS, FURNITURE = {"IL": "SUBJECT", "SS": "INTERVIEWER"}, [r"^[0-9]{1,3}$", "^Some Header$"]
PAGE = """before any tag

SS:
Could you say your
 whole name and

IL:
Some Header
My name is
Tape II
00:05:30
one [laughs] of those

names. And then

SS:
Where were you
12

born. After a trails

IL:
In the city.

at last."""


def lines(spark, *texts):
    return spark.createDataFrame([(k, i, line) for k, text in enumerate(texts) for i, line in enumerate(text.split("\n"))], "k int, line_no int, line string").repartition(3)


def test_displaced_lines_refill_the_oldest_open_turn(spark):
    turns, marks = transcripts.rebuilt(lines(spark, PAGE, "", "SS:\n\n\nIL:"), "k", TAGS, FURNITURE, [("trails", "trials")])
    assert [tuple(r) for r in turns.orderBy("k", "turn").collect()] == [
        (0, 0, None, "before any tag names. And then born. After a trials at last."), (0, 1, "INTERVIEWER", "Could you say your whole name and"),
        (0, 2, "SUBJECT", "My name is one of those"), (0, 3, "INTERVIEWER", "Where were you"), (0, 4, "SUBJECT", "In the city."),
    ]
    assert [tuple(r) for r in marks.collect()] == [(0, 0, 2, 330, "one of those Where were you In the city.")]


def test_nulls_repeated_marks_and_no_lines(spark):
    rows = [(1, 0, "SS:"), (1, 1, None), (1, 2, "Tape I"), (1, 3, "00:00:01"), (1, 4, "00:00:02"), (1, 5, "Tape IV"), (1, 6, "01:00:00"), (1, 7, "go on. "), (1, 8, "")]
    frame = spark.createDataFrame(rows, "k int, line_no int, line string")
    turns, marks = transcripts.rebuilt(frame, "k", TAGS, FURNITURE, [])
    assert [tuple(r) for r in turns.collect()] == [(1, 0, "INTERVIEWER", "00:00:02 go on.")]
    assert sorted(tuple(r) for r in marks.collect()) == [(1, 0, 1, 1, "00:00:02 go on."), (1, 1, 4, 3600, "go on.")]
    turns, marks = transcripts.rebuilt(frame.limit(0), "k", TAGS, FURNITURE, [])
    assert turns.count() == marks.count() == 0


def test_fold_against_texts(spark):
    rng = random.Random(2)
    for _ in range(200):
        fold, texts = transcripts.Fold(), []
        for _ in range(40):
            opens, wraps, ended = rng.random() < 0.3, rng.random() < 0.4, rng.random() < 0.5
            want = len(texts) if opens or not texts else len(texts) - 1 if wraps else next((i for i, t in enumerate(texts) if not t.endswith(".")), len(texts) - 1)
            if want == len(texts):
                texts.append("")
            texts[want] += " x." if ended else " x"
            assert fold.place(opens, wraps, ended) == want


def test_turns_must_agree_with_the_clean_text(spark):
    turns = spark.createDataFrame([(1, 0, "a b"), (1, 1, " c"), (2, 0, "d")], "k int, turn int, text string")
    clean = spark.createDataFrame([(1, "a\nb  c"), (2, "d")], "k int, text string")
    assert sorted(r["text"] for r in transcripts.must_agree(turns, clean, "k").collect()) == ["a b  c", "d"]
    for odd in ([(1, "a b x"), (2, "d")], [(1, "a b c")], [(1, "a b c"), (2, "d"), (3, "e")]):
        with pytest.raises(PySparkException, match="differ in"):
            transcripts.must_agree(turns, spark.createDataFrame(odd, "k int, text string"), "k").collect()


def test_cleaned_counts_each_rule(spark):
    raw = "\ufeffTape III\tfirst line 00:30:00\n\n 12 \nSome Header 3\nAF: say {cough} [sic] hi erar chai\nX\n"
    made = transcripts.cleaned(F.col("t"), [(r"^Tape III\t", ""), (r"\s*\d\d:\d\d:\d\d\s*$", "")], [(r"^\d{1,3}$", "page"), (r"^Some Header", "header"), ("^[A-Z]$", "debris")], [(r"(^|\s)AF:\s*", "$1", "tags"), (r"\{[^}]*\}", "", "stage"), (r"\[[^\]]*\]\s*", "", "editorial"), ("hi erar chai", "hierarchical", "repair")])
    rows = spark.createDataFrame([(0, raw), (1, None), (2, "")], "i int, t string").select("i", made.alias("c")).orderBy("i").collect()
    assert rows[0]["c"]["text"] == "first line say hierarchical"
    assert {x["rule"]: x["n"] for x in rows[0]["c"]["counts"]} == {"cuts": 2, "page": 1, "header": 1, "debris": 1, "tags": 1, "stage": 1, "editorial": 1, "repair": 1}
    assert rows[1]["c"]["text"] == rows[2]["c"]["text"] == ""


def test_speech_runs(spark):
    said = {"a": "0110" + "0111", "b": "1", "c": "00", "d": "1111"}
    rows = [(k, i // 4, i % 4, [0.0, 1.0] if s == "1" else [1.0, 0.5], 4000 if k != "d" else 0) for k, v in said.items() for i, s in enumerate(v)]
    rows += [("e", 0, 0, [0.5, 0.5], 99), ("e", 0, 1, None, 99), ("e", 0, 2, [], 99)]
    got = sorted(tuple(r) for r in frames.speech(spark.createDataFrame(rows, "k string, window int, frame int, scores array<float>, total_samples long"), "k", 1).collect())
    at = lambda n: 721.0 + 270 * n
    assert got == [("a", at(1), at(3)), ("a", at(5), 4000.0), ("b", at(0), 4000.0), ("d", at(0), at(0)), ("e", at(0), at(1))]
    padded = spark.createDataFrame([([1.0] * 5,), ([],), ([2.0] * 4,)], "x array<float>").select(frames.padded_windows(F.col("x"), 2, 1).alias("w")).collect()
    assert [r["w"] for r in padded] == [[[1.0, 1.0], [1.0, 1.0], [1.0, 0.0]], [], [[2.0, 2.0], [2.0, 2.0]]]


def test_paths_keep_every_path_and_filters_keep_rows(spark):
    start = spark.createDataFrame([(1,), (2,), (2,), (None,)], "i int")
    has = spark.createDataFrame([(1, 10, 0.5), (2, 20, 1.5), (2, 20, 2.5), (None, 3, 0.0)], "a int, b int, t double")
    fact = spark.createDataFrame([(20, 7), (20, 8), (20, None), (11, 9)], "x int, y int")
    got = graph.paths(start, [graph.Hop(has, "a", "b", "i", "s", ("t",)), graph.Hop(fact, "x", "y", "s", only_filter=True)])
    assert sorted(tuple(r) for r in got.collect()) == [(2, 20, 1.5), (2, 20, 1.5), (2, 20, 2.5), (2, 20, 2.5)]
    assert "LeftSemi" in got._jdf.queryExecution().toString()


def test_zip_fails_on_unequal_numbers(spark):
    texts = spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (2, 0, "c")], "r int, pos int, uid string")
    vectors = spark.createDataFrame([(1, 0, [1.0]), (1, 1, [2.0]), (2, 7, [3.0])], "r int, pos int, vector array<double>")
    assert sorted((r["uid"], r["vector"]) for r in graph.zipped(texts, vectors, "r").collect()) == [("a", [1.0]), ("b", [2.0]), ("c", [3.0])]
    for x, y in ((texts, vectors.where("r = 1")), (texts.where("r = 2"), vectors), (texts.where("pos < 9"), vectors)):
        with pytest.raises(PySparkException, match="texts and"):
            graph.zipped(x, y, "r").collect()


def test_decoding_replaces_the_longest_invalid_parts(spark):
    rng = random.Random(1)
    parts = [b"a", b" ", b"\xe9", b"\xc3\xa9", b"\xe2\x82\xac", b"\xe2\x82", b"\xf0\x9f\x98\x80", b"\xf0\x9f\x98", b"\xc0\x80", b"\xe0\x80\x80", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\xff", b"\x80"]
    data = [b"caf\xe9", b"", *(b"".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(800))]
    got = spark.createDataFrame([(bytearray(d),) for d in data], "b binary").select("b", words.decoded(F.col("b")).alias("t")).collect()
    assert all(r["t"] == bytes(r["b"]).decode("utf-8", "replace") for r in got)
    tokens = spark.createDataFrame([(1, i, bytearray(b), 0.0, 1.0) for i, b in enumerate((b" caf", b"\xc3", b"\xa9", b" x\xe9"))], "k int, idx int, bytes binary, at double, p double")
    assert [r["text"] for r in words.assemble(tokens, "k").orderBy("word").collect()] == ["café", "x�"]


def test_planted_offsets(spark):
    ship(spark)
    rng = np.random.default_rng(5)
    rows, want = [], []
    for lag in (0, 1, 159, 160, 777, -766, 3000, -2112):
        a = rng.normal(size=40_000) * np.repeat(rng.uniform(0.1, 3, 100), 400)
        b = np.concatenate((rng.normal(size=lag) * 0.1, a)) if lag >= 0 else a[-lag:]
        rows.append((lag, a.tolist(), b.tolist()))
        want.append(lag)
    frame = spark.createDataFrame([*rows, (None, [], [1.0]), (None, None, [1.0])], "lag int, a array<double>, b array<double>")
    got = frame.withColumn("got", signals.global_offset(F.col("a"), F.col("b"))).withColumn("s", signals.shifted(F.col("a"), F.col("b"), F.col("got"))).select("lag", "got", F.size("s.a").alias("n"), (F.col("s.a") == F.col("s.b")).alias("same")).collect()
    assert [r["got"] for r in got[: len(want)]] == want and all(r["same"] for r in got[: len(want)])
    assert [r["got"] for r in got[len(want) :]] == [0, None]


def test_fft_search_is_the_direct_one():
    rng = np.random.default_rng(3)
    for _ in range(100):
        a, b = rng.normal(size=rng.integers(1, 40)), rng.normal(size=rng.integers(1, 40))
        direct = [(signals._correlation(a, b, k), -k) for k in range(-12, 13) if -len(a) < k < len(b)]
        best, back = max(direct)
        got = signals.lag_by_fft(a, b, -12, 12)
        assert got[1] == -back and got[0] == pytest.approx(best)
