"""Scoring of recordings: small cases with known answers, nulls and empty arrays, edit scripts against a plain matrix."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talespan.operators import evaluate, scoring, words
from talespan.runtime import ship

SCHEMA = """conv_id int, truth array<string>, turns array<struct<speaker:string,tokens:array<string>>>,
segments array<struct<start_time:double,end_time:double,tokens:array<string>,words:array<struct<text:string,start:double,end:double,tokens:array<string>>>>>,
anchors array<struct<tape:int,label:string,tape_seconds:double,phrase:array<string>>>"""
KEY = ["conv_id"]


def segment(text, start=0.0, end=1.0, words=()):
    return (start, end, text.split(), [(w, a, b, w.lower().split()) for w, a, b in words])


def recording(spark, truth, segments, turns=None, anchors=None, n=0):
    ship(spark)
    return spark.createDataFrame([(n, truth.split(), turns, segments, anchors)], SCHEMA)


def terms(spark, *names):
    return spark.createDataFrame([(i, t, t.split()) for i, t in enumerate(names)], "term_id int, term string, words array<string>")


def test_scorecards_of_a_perfect_transcript_and_a_missed_term(spark):
    ship(spark)
    rec = spark.createDataFrame([(i, "act up received badly".split(), None, [segment(h)], None) for i, h in enumerate(("act up received badly", "acta up received badly"))], SCHEMA)
    c, d = scoring.scorecards(rec, terms(spark, "act up", "gmhc"), KEY).orderBy("conv_id").collect()
    assert c["wer"]["rate"] == 0 and c["lexicon"]["recall"] == 1 and c["harness_version"] == 4
    (t,) = d["lexicon"]["terms"]
    assert (t["term"], t["expected"], t["found"], t["confusions"]) == ("act up", 1, 0, ["acta"]) and d["lexicon"]["recall"] == 0


def test_confusions_are_six_sorted_distinct_and_terms_by_misses(spark):
    truth = " ".join(f"x{i} up v{i}" for i in range(9)) + " dog dog dog"
    heard = " ".join(f"x{i} {w} v{i}" for i, w in enumerate("h g f e d c b a a".split())) + " dog cat dog"
    rec = recording(spark, truth, [segment(heard)])
    ranges = scoring.spans(rec, KEY)
    each, whole = scoring.lexicon_report(rec, ranges, scoring.edits(rec, ranges, KEY), terms(spark, "dog dog", "dog", "up", "x1 up v1", "", "nowhere"), KEY)
    rows = [(r["term"], r["expected"], r["found"], r["confusions"]) for r in each.orderBy("rank").collect()]
    assert rows == [("up", 9, 0, list("abcdef")), ("dog", 3, 2, ["cat"]), ("dog dog", 1, 0, ["cat"]), ("x1 up v1", 1, 0, list("abcdef"))]  # by token, wherever it was heard so
    assert whole.first()["recall"] == pytest.approx(2 / 14)


def test_fillers_and_stutters_are_not_content(spark):
    cases = [("well i think", "well um i think obviously", 1, 1), ("it was difficult", "it was you know difficult", 2, 0), ("we things", "we know things", 0, 1), ("that was in the room", "that was in the the room", 1, 0)]
    ship(spark)
    rec = spark.createDataFrame([(i, t.split(), None, [segment(h)], None) for i, (t, h, _, _) in enumerate(cases)], SCHEMA)
    ranges = scoring.spans(rec, KEY)
    rows = scoring.error_report(rec, ranges, scoring.edits(rec, ranges, KEY), KEY).orderBy("conv_id").collect()
    assert [(r["ins_filler"], r["ins_content"]) for r in rows] == [c[2:] for c in cases]


def test_word_structure(spark):
    words = [("[_BEG_]", 0.0, 0.0), ("Okay.[_TT_42]", 0.0, 0.84), ("back", 3.0, 2.0), ("slow", 3.0, 5.5), ("longlonglonglong", 3.0, 6.9)]
    rec = spark.createDataFrame([(0, [], None, [segment("okay.", 0.0, 0.84, words)], None), (1, [], None, [segment("a", 0.0, 0.5), segment("b", 30.0, 59.98), segment("c", 60.0, 67.5)], None)], SCHEMA)
    s, t = scoring.structure_report(rec, KEY).orderBy("conv_id").collect()
    assert (s["words"], s["control_token_words"], s["zero_duration_words"], s["backwards_time_words"], s["implausible_duration_words"]) == (5, 2, 2, 1, 1)
    assert t["boundary_quantization"] == 1.0 and t["median_segment_seconds"] == 7.5


def test_drift_fits_offset_and_slope(spark):
    words = [("alpha", 700.0, 700.5), ("beta", 1000.0, 1000.5), ("beta", 1200.0, 1200.5)]
    marks = [(3, "A", 800.0, ["alpha"]), (3, "B", 1100.0, ["beta", "unheard"]), (3, "C", 1100.0, ["beta"]), (1, "D", 1.0, []), (1, "E", 5.0, ["beta"])]
    rows, slope = scoring.drift_report(scoring.located(recording(spark, "alpha beta beta", [segment("alpha beta beta", 700.0, 1000.5, words)], anchors=marks), KEY), KEY)
    assert slope.first()["time_slope"] == pytest.approx(1.0)
    drift = rows.orderBy("at").collect()
    assert [d["media_seconds"] for d in drift] == [700.0, None, 1000.0, None, 1000.0]
    assert [d["residual"] is None for d in drift] == [False, True, False, True, True]


def test_prefix_of_three_is_enough_and_the_longest_wins(spark):
    words = [(w, float(i), i + 0.5) for i, w in enumerate("a b c x a b c d y a b q".split())]
    rec = recording(spark, "a b c x a b c d y a b q", [segment("", words=words)], anchors=[(1, "L", 0.0, "a b c d e f".split()), (1, "P", 0.0, "a b q z".split()), (1, "N", 0.0, "y z z".split())])
    got = {r["label"]: r["media_seconds"] for r in scoring.located(rec, KEY).collect()}
    assert got == {"L": 4.0, "P": 9.0, "N": None}


def test_places_of_marks_are_made_once_and_carry_no_text(spark):
    rec = recording(spark, "a b", [segment("a b", words=[("a", 0.0, 0.5), ("b", 1.0, 1.5)])], anchors=[(1, "L", 0.0, ["a", "b", None]), (1, "N", 0.0, [None, "b"])])
    places = scoring.located(rec, KEY)
    assert "slice(s#" not in places._jdf.queryExecution().optimizedPlan().toString()  # following tokens for each place
    rows, slope = scoring.drift_report(places, KEY)
    assert all("Generate" not in df._jdf.queryExecution().optimizedPlan().toString() for df in (rows, slope))
    assert [r["media_seconds"] for r in rows.orderBy("at").collect()] == [None, None]


def test_speaker_report(spark):
    turns = [("A", "one two three four".split()), ("B", "five six seven".split()), ("A", "eight nine ten".split())]
    rec = recording(spark, " ".join(" ".join(t) for _, t in turns), [segment("one two three four"), segment("five six seven eight nine ten")], turns)
    ops = scoring.edits(rec, scoring.spans(rec, KEY), KEY)
    r = scoring.speaker_report(rec, ops, KEY).first()
    assert (r["changes"], r["covered"], r["bleed"]) == (2, 1, 1)
    assert (r["expected_by_chance"], r["lift"], r["mean_segment_tokens"]) == pytest.approx((0.4, 2.5, 5.0))
    odd = recording(spark, "one two", [segment("one two")], [("A", ["one"]), ("B", ["two", "three"])])
    assert scoring.speaker_report(odd, scoring.edits(odd, scoring.spans(odd, KEY), KEY), KEY).collect() == []


def test_null_and_empty_arrays(spark):
    ship(spark)
    rec = spark.createDataFrame([(0, None, None, None, None), (1, [], [], [], []), (2, ["a"], None, None, None), (3, None, None, [segment("b")], None)], SCHEMA)
    rows = {r["conv_id"]: r for r in scoring.scorecards(rec, terms(spark, "a", "zz"), KEY).collect()}
    assert sorted(rows) == [0, 1, 2, 3]
    assert [(rows[i]["wer"]["truth_tokens"], rows[i]["wer"]["rate"], rows[i]["lexicon"]["recall"]) for i in range(4)] == [(0, 0.0, 1.0), (0, 0.0, 1.0), (1, 1.0, 0.0), (0, 0.0, 1.0)]
    assert rows[3]["wer"]["ins_content"] == 1 and rows[0]["structure"]["segments"] == 0 and rows[0]["structure"]["time_slope"] is None
    assert scoring.scorecards(rec.limit(0), terms(spark, "a"), KEY).collect() == []


def plain_script(a, b):
    cost = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    out, i, j = [], len(a), len(b)
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            out.append(("match" if a[i] == b[j] else "sub", a[i], b[j]))
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            out.append(("del", a[i], None))
        else:
            j -= 1
            out.append(("ins", None, b[j]))
    return out[::-1]


def test_edit_script_is_that_of_the_whole_matrix():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 24))] for _ in range(2))
        assert evaluate.edit_script(a, b) == plain_script(a, b)
    long = ["w%d" % (i % 700) for i in range(3000)]
    assert all(o[0] == "match" for o in evaluate.edit_script(long, long))


def test_scripts_leave_a_task_some_edits_at_a_time(monkeypatch):
    monkeypatch.setattr(evaluate, "EDITS_AT_ONCE", 50)
    rng = random.Random(2)
    pairs = [[[rng.choice(["a", "b", "c", None]) for _ in range(rng.randrange(0, 24))] for _ in range(2)] for _ in range(40)] + [[None, ["a"]], [["b"], None]]
    given = pa.RecordBatch.from_pydict({"k": list(range(len(pairs))), "truth": pa.array([p[0] for p in pairs], pa.list_(pa.string())), "heard": pa.array([p[1] for p in pairs], pa.list_(pa.string()))})
    out = list(evaluate._scripts([given]))
    assert len(out) > 5 and max(b.num_rows for b in out) < 100
    rows = [r for b in out for r in b.to_pylist()]
    for k, (t, h) in enumerate(pairs):
        mine = [r for r in rows if r["k"] == k]
        assert [(r["op"], r["truth"], r["heard"]) for r in mine] == plain_script(t or [], h or [])
        assert [r["idx"] for r in mine] == list(range(len(mine)))
        assert [r["truth_pos"] for r in mine] == [sum(x["op"] != "ins" for x in mine[:i]) for i in range(len(mine))]


def test_edit_script_in_blocks(monkeypatch):
    monkeypatch.setattr(evaluate, "KEPT_CELLS", 1)
    rng = random.Random(4)
    for _ in range(100):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(0, 60))] for _ in range(2))
        assert evaluate.edit_script(a, b) == plain_script(a, b)


def test_tokens_are_not_broadcast(spark):
    rec = recording(spark, "a b c", [segment("a b c")], [("A", ["a", "b", "c"])])
    ranges = scoring.spans(rec, KEY)
    joins = lambda df: [x for x in df._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in x]
    assert any("SortMergeJoin" in x and "token" in x for x in joins(ranges))
    assert any("SortMergeJoin" in x and "heard_pos" in x for x in joins(scoring.speaker_report(rec, scoring.edits(rec, ranges, KEY), KEY)))


def test_place_of_a_suspect_is_sought_once(spark):
    rows = spark.createDataFrame([(1, [("a", 0.9), ("b", 0.01), ("c", 0.5)]), (2, [("a", 0.9)]), (3, None), (4, [])], "k int, w array<struct<word:string,p:double>>")
    found = rows.select("k", words.suspects(F.col("w")).alias("context"))
    assert [r["context"] for r in found.orderBy("k").collect()] == ["a «b» c", None, None, None]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("array_position") == 1


def odd_conversations(spark, tmp_path):
    """Conversations that repeat the one before, or a part of it, with one where a turn has no text."""
    said = [(0, 0, "user", "a b c"), (1, 0, "user", "a b c"), (2, 0, "user", "the a b c the"), (3, 0, "user", None), (3, 1, "assistant", "a b d"), (4, 0, "user", "d b"), (4, 1, "user", None), (4, 2, "user", "d")]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def test_scorecards_query_where_nothing_is_substituted_or_said(spark, tmp_path):
    import duckdb

    from talespan import catalog

    d = odd_conversations(spark, tmp_path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS FROM read_parquet('{d}/conversations.parquet/*.parquet')")
    want = con.sql(catalog.ORACLES["scorecards"])
    rows = catalog.QUERIES["scorecards"](spark, d).select(*want.columns).collect()
    plain = lambda r: tuple(str(x) for x in r)
    assert len(rows) == 4 and sorted(map(plain, rows)) == sorted(map(plain, want.fetchall()))
    assert [r["top_substitution"] for r in sorted(rows)][:2] == ["", ""]


def test_null_words_of_a_segment_leave_those_of_the_others(spark):
    words = [(i, i / 2, i / 2 + 0.4, [t] if t else None) for i, t in enumerate(("a", None, "b"))]
    silent = (0.0, 1.0, None, None)
    spoken = (1.0, 2.0, ["a", "b"], [(str(w), x, y, t) for w, x, y, t in words])
    rec = recording(spark, "a b", [silent, spoken], anchors=[(1, "L", 0.0, ["b"])])
    assert scoring.structure_report(rec, KEY).first()["words"] == 3
    assert scoring.located(rec, KEY).first()["media_seconds"] == 1.0


def test_marks_use_known_ranges_unless_the_timed_words_differ(spark):
    heard = [f"t{i}" for i in range(90)]
    words = lambda said: [(t, i / 2, i / 2 + 0.4, [t]) for i, t in enumerate(said)]
    rows = [(k, heard, None, [(0.0, 50.0, heard, words(said))], [(1, "L", 0.0, ["t70", "t71", "t72"]), (1, "M", 9.0, ["t3", "zz", "t5"])]) for k, said in enumerate((heard, heard[60:], []))]
    kind = recording(spark, "a", []).schema
    rec = spark.createDataFrame([dict(zip(kind.names, r, strict=True)) for r in rows], kind)
    places = lambda *ranges: sorted((r["conv_id"], r["at"], r["media_seconds"]) for r in scoring.located(rec, KEY, *ranges).collect())
    found = places(scoring.spans(rec, KEY))
    assert found == places() and [m for _, at, m in found if at == 0] == [35.0, 5.0, None]


def test_only_insertions_and_what_stands_beside_them_become_objects(monkeypatch):
    seen, real = [], evaluate.insertion_kinds
    monkeypatch.setattr(evaluate, "insertion_kinds", lambda ops: seen.append(len(ops)) or real(ops))
    same = [("match", t, t) for t in "abcdefgh"]
    scripts = [[*same, ("ins", None, "h"), ("ins", None, "x"), ("match", "y", "y"), ("ins", None, "y"), *same], None, [], [*same, ("ins", None, "um")], same, [("ins", None, "a"), *same]]
    kind = pa.list_(pa.struct([("op", pa.string()), ("truth", pa.string()), ("heard", pa.string())]))
    column = pa.array([s and [dict(zip(("op", "truth", "heard"), o, strict=True)) for o in s] for s in scripts], kind)
    found = evaluate.classify_insertions.func(column).to_pylist()
    assert [(x["filler"], x["content"]) for x in found] == [real(s or []) for s in scripts] == [(2, 1), (0, 0), (0, 0), (1, 0), (0, 0), (1, 0)]
    assert sum(seen) < 14 < sum(map(len, filter(None, scripts)))
