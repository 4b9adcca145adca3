import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from talespan.operators import archive, assembly, corpus, evaluate, intervals, speakers, words
from talespan.sources import files, sinks
from talespan.streaming import jobs


def kinds(a, b):
    return [o for o, _, _ in evaluate.edit_script(a.split(), b.split())]


def test_edit_script():
    assert kinds("cut up received badly", "cuta received badly").count("match") == 2
    assert kinds("cut up", "cuta up") == ["sub", "match"]
    assert kinds("the cat sat on the mat", "the cat sat on a mat") == ["match"] * 4 + ["sub", "match"]
    assert kinds("x", "y") == ["sub"]
    assert kinds("", "a b") == ["ins", "ins"] and kinds("a", "") == ["del"]
    rng = random.Random(1)
    for _ in range(60):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(2))
        d = np.zeros((len(a) + 1, len(b) + 1), int)
        d[0, :], d[:, 0] = np.arange(len(b) + 1), np.arange(len(a) + 1)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j - 1] + (a[i - 1] != b[j - 1]), d[i - 1, j] + 1, d[i, j - 1] + 1)
        ops = evaluate.edit_script(a, b)
        assert sum(o != "match" for o, _, _ in ops) == d[-1, -1]
        assert [t for _, t, _ in ops if t is not None] == a and [h for _, _, h in ops if h is not None] == b


def test_anchors(spark):
    same = [f"w{i}" for i in range(50)]
    shared, extra = [f"s{i}" for i in range(400)], [f"x{i}" for i in range(400)]
    late = [f"l{i}" for i in range(300)]
    rows = [(1, same, same), (2, shared + extra, shared), (3, [], ["a"]), (4, ["a"], ["b"]), (5, extra, late + extra), (6, None, ["a"])]
    frame = spark.createDataFrame(rows, "k int, truth array<string>, heard array<string>").where("truth is not null")
    got = {r["k"]: tuple(r)[1:] for r in evaluate.anchors(frame, ["k"]).collect()}
    assert got[1] == (0, 50, 0, 50, 50, False)
    t0, t1, h0, h1, _, partial = got[2]
    assert partial and t1 <= 480 and t1 - t0 >= 380 and (h0, h1) == (0, 400)
    assert got[3] == (0, 0, 0, 1, 0, False) and got[4] == (0, 1, 0, 1, 0, False)
    assert got[5][:4] == (0, 400, 268, 700) and got[5][5]
    ops = evaluate.ops_table(frame, ["k"]).where("k = 1").collect()
    assert len(ops) == 50 and {o["op"] for o in ops} == {"match"}


def test_insertions():
    ins = lambda *w: [("ins", None, x) for x in w]
    m = lambda w: ("match", w, w)
    assert evaluate.insertion_kinds([m("well"), *ins("um"), m("i"), m("think"), *ins("obviously")]) == (1, 1)
    assert evaluate.insertion_kinds([m("it"), m("was"), *ins("you", "know"), m("difficult")]) == (2, 0)
    assert evaluate.insertion_kinds([m("we"), *ins("know"), m("things")]) == (0, 1)
    assert evaluate.insertion_kinds([m("in"), m("the"), *ins("the"), m("room")]) == (1, 0)


def test_find_all():
    assert evaluate.find_all("a a a a".split(), ["a", "a"]) == [0, 2]
    assert evaluate.find_all(["a"], []) == []


def test_drift(spark):
    df = spark.createDataFrame([(1, 800.0, 700.0), (1, 1100.0, 1000.0), (2, 5.0, None)], "tape int, tape_seconds double, media_seconds double")
    rows = evaluate.drift(df).orderBy("tape", "tape_seconds").collect()
    assert rows[0]["slope"] == pytest.approx(1) and rows[1]["residual"] == pytest.approx(0) and rows[2]["residual"] is None


def test_to_original(spark):
    regions = spark.createDataFrame([("f", 2.0, 0.0, 3.0), ("f", 15.0, 3.1, 3.0)], "file string, orig_start double, filtered_start double, duration double")
    points = spark.createDataFrame([("f", t) for t in (1.5, 3.05, 4.5, 99.0)], "file string, t double")
    got = {r["t"]: r["original"] for r in intervals.to_original(points, regions, ["file"]).collect()}
    assert got == pytest.approx({1.5: 3.5, 3.05: 5.0, 4.5: 16.4, 99.0: 18.0})


def test_dominant_speaker(spark):
    speech = spark.createDataFrame([(1, "00", 0.0, 3.0), (1, "01", 3.0, 5.0), (1, "00", 5.0, 8.0), (2, "02", 0.0, 2.0)] + [(2, "03", 2.0 + k, 2.5 + k) for k in range(5)], "f int, speaker string, r_start double, r_end double")
    seg = spark.createDataFrame([(1, 1, 0.0, 8.0), (1, 2, 2.5, 4.5), (1, 3, 10.0, 12.0), (2, 4, 0.0, 8.0)], "f int, segment int, l_start double, l_end double")
    got = {r["segment"]: r["speaker"] for r in intervals.dominant(seg, speech, ["f"], 4.0).collect()}
    assert got == {1: "00", 2: "01", 3: None, 4: "03"}


def test_overlap_counts_once(spark):
    rng = random.Random(3)
    make = lambda: [(i, a := rng.uniform(0, 40), a + rng.uniform(0, 25)) for i in range(40)]
    left, right = make(), make()
    got = intervals.overlaps(spark.createDataFrame([(1, *r) for r in left], "k int, i int, l_start double, l_end double"), spark.createDataFrame([(1, *r) for r in right], "k int, j int, r_start double, r_end double"), ["k"], 5.0)
    want = {(i, j) for i, a, b in left for j, c, d in right if min(b, d) - max(a, c) > 0}
    rows = [(r["i"], r["j"]) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_clusters():
    rng = np.random.default_rng(0)
    big, small = rng.normal([5, 0, 0], 0.1, (12, 3)), rng.normal([0, 5, 0], 0.1, (2, 3))
    labels = speakers.cluster_vectors(np.concatenate((big, small)), 2)
    assert set(labels[:12]) == {0} and set(labels[12:]) == {1}
    assert speakers.cluster_vectors(np.empty((0, 3)), 4) == [] and speakers.cluster_vectors(np.ones((1, 3)), 4) == [0]


def test_assignment():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(1, 5))
        gain = rng.integers(0, 9, (n, int(rng.integers(n, 6)))).astype(float)
        chosen = speakers.assignment(gain)
        best = max(sum(gain[i, p[i]] for i in range(n)) for p in itertools.permutations(range(gain.shape[1]), n))
        assert len(set(chosen)) == n and sum(gain[i, j] for i, j in enumerate(chosen)) == best


def test_diarization_score(spark):
    turns = spark.createDataFrame([(1, i, float(i), i + 1.0, "XYX"[i]) for i in range(3)], "k int, segment int, l_start double, l_end double, name string")
    said = [(1, "a", 0.0, 1.0), (1, "b", 1.0, 2.0), (1, "b", 2.0, 2.1)]
    guess = lambda more: spark.createDataFrame(said + more, "k int, speaker string, r_start double, r_end double")
    score = lambda more: assembly.diarization_score(turns, guess(more), "k", 10.0).first()["accuracy"]
    assert score([]) == round(2 / 3, 6) and score([(1, "a", 2.1, 3.0)]) == 1.0
    assert score([(1, "c", 2.0, 2.05)]) == 0.0  # three labels, two names


def test_word_assembly(spark):
    rows = [(1, 0, b" don", 1.0, 0.9), (1, 1, b"\xe2\x80", 1.1, 0.8), (1, 2, b"\x99", 1.2, 0.7), (1, 3, b"t", 1.3, 0.95), (1, 4, b" go", 2.0, 0.5)]
    got = words.assemble(spark.createDataFrame(rows, "seg int, idx int, bytes binary, at double, p double"), "seg").orderBy("word").collect()
    assert [(r["text"], r["start"], r["p"]) for r in got] == [("don’t", 1.0, 0.7), ("go", 2.0, 0.5)]


def test_audio(spark):
    rows = [(1, i, v) for i, v in enumerate([1.0, 3.0, -2.0, 2.0, 0.5, 0.5, 9.0])]
    got = words.to_mono(spark.createDataFrame(rows, "f int, i int, value double"), ["f"], 2).orderBy("frame").collect()
    assert [r["value"] for r in got] == [2.0, 0.0, 0.5]
    t = np.arange(4800) / 48000
    out = words.resample(np.sin(2 * np.pi * 440 * t), 48000, 16000)
    assert len(out) == 1600
    assert np.abs(out[200:1400] - np.sin(2 * np.pi * 440 * np.arange(1600) / 16000)[200:1400]).max() < 0.02
    with pytest.raises(ValueError):
        words.resample(np.ones(4), 48000, 100)


def test_interpolate_without_anchors(spark):
    df = spark.createDataFrame([("a", i, None) for i in range(3)] + [("b", i, 100.0 if i == 2 else None) for i in range(4)], "k string, seq int, anchor double")
    got = {(r["k"], r["seq"]): r["seconds"] for r in intervals.interpolate(df, ["k"], "seq", "anchor").collect()}
    assert got == {("a", 0): -1, ("a", 1): -1, ("a", 2): -1, ("b", 0): 90, ("b", 1): 95, ("b", 2): 100, ("b", 3): 105}


def test_ingest_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "s")
    seed = lambda n, t: spark.createDataFrame([(n, f'[{{"text": "{t}", "start_time": 0.0, "end_time": 1.0, "extra": 1}}]')], "number long, segments string")
    for s in (seed(1, "one"), seed(2, "two"), seed(1, "uno"), seed(1, "uno")):
        sinks.replace_interviews(sinks.statements(s), path)
    got = spark.read.parquet(path).orderBy("interview").collect()
    assert [(r["interview"], r["text"], r["speaker"]) for r in got] == [(1, "uno", "SPEAKER_??"), (2, "two", "SPEAKER_??")]


def test_lookup_errors(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "number long, uid string")
    assert archive.interview_lookup(df, number=2).first()["uid"] == "b"
    with pytest.raises(ValueError):
        archive.interview_lookup(df)
    with pytest.raises(LookupError):
        archive.interview_lookup(df, uid="a", number=2)


def test_files(spark, tmp_path):
    (tmp_path / "lex.txt").write_text("# names\nAZT\n\n azt \nGMHC\n")
    assert [r["term"] for r in files.lexicon(spark, str(tmp_path / "lex.txt")).orderBy("pos").collect()] == ["AZT", "GMHC"]
    text = "1\n00:00:01:00 - 00:00:02:15\nANN\nHello\n\n2\n00:00:03:00 - 00:00:04:00\nBOB\nYes"
    turns = spark.range(1).select(files.reference_turns(F.lit(text)).alias("t")).first()["t"]
    assert [(t["start"], t["end"], t["speaker"]) for t in turns] == [(1.0, 2.5, "ANN"), (3.0, 4.0, "BOB")]
    conf = spark.range(1).select(files.config(F.lit('{"decode": {"beam_size": 1}, "unknown": 2}')).alias("c")).first()["c"]
    assert conf["decode"]["beam_size"] == 1 and conf["decode"]["language"] == "en" and conf["diarize"]["max_speakers"] == 4


def test_job_steps():
    assert jobs.step("", "submit", "a") == ("started", "a")
    assert jobs.step("a", "submit", "b") == ("busy", "a")
    assert jobs.step("", "cancel", "a") == ("not_running", "")
    assert jobs.step("a", "cancel", "b") == ("id_mismatch", "a")
    assert jobs.step("a", "done", "a") == ("done", "")


def test_registry_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "slot string, seq long, kind string, job string"
    spark.createDataFrame([("s", 1, "submit", "a"), ("s", 2, "submit", "b"), ("s", 3, "done", "a"), ("s", 4, "submit", "b")], schema).coalesce(1).write.parquet(src)
    q = jobs.registry(spark.readStream.schema(schema).parquet(src)).writeStream.format("memory").queryName("jobs").outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [r["reply"] for r in spark.table("jobs").orderBy("seq").collect()] == ["started", "busy", "done", "started"]


def test_mono_topics(spark):
    df = spark.createDataFrame([(1, "AIDS\nfoo AZT"), (2, "nothing")], "d int, text string")
    assert [tuple(r) for r in corpus.topic_hits(corpus.lines_of(df, "d"), "d", ["aids", "azt"]).collect()] == [(1, 2)]


def test_phrase_search(spark):
    t = pd.Series([["a", "b", "c", "d", "x"], ["a", "b"]])
    tokens = spark.createDataFrame([(1, list(t[0])), (2, ["b", "b", "b", "ab", "b"]), (3, []), (4, None)], "k int, tokens array<string>")
    assert {tuple(r) for r in assembly.phrase_counts(tokens, "k", [["b", "c"], ["b", "b"], ["b"]]).collect()} == {(1, "b c", 1), (1, "b", 1), (2, "b b", 1), (2, "b", 4)}
    assert assembly.locate.func(t, pd.Series([["b", "c", "d", "q"], ["b"]])).tolist() == [1, 1]


def test_vad_timeline(spark):
    from talespan.operators.assembly import vad_timeline

    df = spark.createDataFrame([("f", 2.0, 4.0, 20.0), ("f", 10.0, 25.0, 20.0), ("g", 5.0, 5.0, 20.0)], "file string, start double, end double, total double")
    got = [tuple(round(x, 4) if isinstance(x, float) else x for x in r) for r in vad_timeline(df, "file").orderBy("orig_start").collect()]
    assert got == [("f", 2.0, 0.0, 2.1), ("f", 10.0, 2.2, 10.0)]


def test_difflib_wer_compares_every_turn_with_the_next(spark):
    from talespan import catalog
    from tests.conftest import DATA

    turns = {(r["conv_id"], r["turn"]) for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect()}
    got = [(r["conv_id"], r["turn"]) for r in catalog.QUERIES["difflib_wer"](spark, DATA).collect()]
    assert sorted(got) == sorted((c, t) for c, t in turns if (c, t + 1) in turns)


def test_fuzzy_best(spark, monkeypatch):
    import difflib

    monkeypatch.setattr(corpus, "CANDIDATES_AT_ONCE", 3)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeXY") for _ in range(rng.randrange(0, 7)))
    candidates = [word() for _ in range(11)] + ["tide"]
    names = [word() for _ in range(40)] + ["diet", None]
    got = {r["heard"]: (r["name"], r["ratio"]) for r in corpus.fuzzy_best(spark.createDataFrame([(n,) for n in names], "heard string"), spark.createDataFrame(list(enumerate(candidates)), "at int, name string"), "heard", "name", "at").collect()}
    want = {}
    for n in set(names):
        ratios = [difflib.SequenceMatcher(None, c, n or "").ratio() for c in candidates]
        if max(ratios) >= 0.5:
            want[n] = (candidates[ratios.index(max(ratios))], round(max(ratios), 6))
    assert got == want


def test_lexicon_recall_sends_terms_and_not_tokens(spark):
    tokens = lambda *rows: spark.createDataFrame([(t,) for t in rows], "token string")
    terms = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, "zz")], "pos int, term string")
    found = evaluate.lexicon_recall(tokens("a", "a", "a", "b", "c", None), tokens("a", "c", "b", "b"), terms)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 2  # each side's tokens stay where they are read
    want = [("a", 0, 3, 1, 2), ("a", 2, 3, 1, 2), ("b", 1, 1, 1, 0)]
    assert [tuple(r) for r in found.collect()] == want
