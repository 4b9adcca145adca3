"""Normalisation as columns, rosters, manifests, differences, results, parameters and diagnostics on small cases."""

import random
import re
import wave

from pyspark.sql import functions as F

from talespan.functions import normal
from talespan.functions.text import normalize_text
from talespan.operators import corpus, speakers
from talespan.runtime import ship
from talespan.sources import files, manifests, sinks


def test_normalized_columns_equal_the_plain_function(spark):
    ship(spark)
    rng = random.Random(4)
    parts = ["don't", "can not", "isn", "t", "in t", "it", "s", "i", "m", "you", "ve", "we", "‘quoted’", "1999", "2000", "1105", "42", "42", "7000000", "12a", "99999999999999999999", "R&B", "5%", "a=b", "up-to-date", "and/or", "—", "…", "y'all", "gonna", "\xa0", "\u2003x", "\x85", "'tis", "''", " ", " ", "\x1c", "\n", "Größe", "İstanbul", "ΣΑΣ", "naïve", "½", "Ⅷ", "é́", "😀n t", "én t", "ain't", "1,200", "o'clock'"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(0, 12))) for _ in range(600)] + [None, "", " ", *parts]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r["i"]: r["tokens"] for r in normal.normalized(frame, "text").collect()}
    assert [got[i] for i in range(len(texts))] == [normalize_text(t) for t in texts]


def test_members_and_totals(spark):
    docs = spark.createDataFrame([(1, "the Lavender\n Hill Mob met"), (2, "Lavender Hill Mobsters"), (3, None), (4, "MARYS and Lavender Hill Mob"), (4, "MARYS")], "doc_id int, text string")
    roster = corpus.members(docs, "doc_id", ["Lavender Hill Mob", "MARYS"])
    assert sorted(tuple(r) for r in roster.collect()) == [(1, "Lavender Hill Mob"), (4, "Lavender Hill Mob"), (4, "MARYS"), (4, "MARYS")]
    assert tuple(corpus.roster_totals(roster, "doc_id").first()) == (4, 2, 2)
    assert tuple(corpus.roster_totals(roster.limit(0), "doc_id").first()) == (0, 0, 0)


def test_manifests_are_read_and_written(spark, tmp_path):
    (tmp_path / "m.yaml").write_text("# head\ninterviews:\n  - number: 2\n    name: A. Person # note\n    date: 2002-12-14\n    none: null\n\n  - number: 3\n    name: 'It''s: a name'\n    date: \"2003\"\nvideos:\n- id: '0313'\n  size: ~\n")
    rows = [(r["section"], r["entry"], r["fields"]) for r in manifests.manifest(spark, str(tmp_path / "m.yaml")).orderBy("entry").collect()]
    assert rows == [("interviews", 1, {"number": "2", "name": "A. Person", "date": "2002-12-14", "none": None}), ("interviews", 2, {"number": "3", "name": "It's: a name", "date": "2003"}), ("videos", 3, {"id": "0313", "size": None})]
    frame = spark.createDataFrame([("b", 1, None, "it's"), ("a", 20, "null", "plain text")], "stem string, size long, ext string, name string")
    manifests.write_manifest(frame, str(tmp_path / "out"), "stem")
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect())
    assert text == "- ext: 'null'\n  name: plain text\n  size: '20'\n  stem: a\n- ext: null\n  name: 'it''s'\n  size: '1'\n  stem: b"
    (tmp_path / "g.txt").write_text("MARYS\n\nLavender Hill Mob\n")
    assert [r["grp"] for r in manifests.group_list(spark, str(tmp_path / "g.txt")).orderBy("pos").collect()] == ["MARYS", "Lavender Hill Mob"]
    dates = spark.createDataFrame([("2003-02-28",), ("2003-02-30",), (" 2003-01-01 ",), ("2003",), (None,)], "t string").select(manifests.plain_date(F.col("t")).cast("string").alias("d"))
    assert [r["d"] for r in dates.collect()] == ["2003-02-28", None, "2003-01-01", None, None]


def test_differences_and_results_are_written_once(spark, tmp_path):
    pairs = spark.createDataFrame([("2", [(["a", "b"], ["c"]), (["d"], ["e"])]), ("3", [])], "interview string, pairs array<struct<gold:array<string>,heard:array<string>>>")
    manifests.write_differences(pairs, str(tmp_path / "diffs"), "interview")
    manifests.write_differences(pairs.where("interview = '3'"), str(tmp_path / "diffs"), "interview")
    assert [r["value"] for r in spark.read.text(str(tmp_path / "diffs")).where("interview = 2").collect()] == ["a b\t|\tc", "d\t|\te"]
    results, out = spark.createDataFrame([("x", 1), ("y", 2)], "file string, n int"), str(tmp_path / "results")
    done = results.limit(0)
    for _ in range(2):
        manifests.write_results(results, done, out)
        done = spark.read.json(out)
        assert sorted((r["file"], r["n"]) for r in done.collect()) == [("x", 1), ("y", 2)]


def test_lexicons_keep_the_first_of_equal_tokens(spark, tmp_path):
    (tmp_path / "l.txt").write_text("# list\nSilence = Death\n\nSILENCE = DEATH\nsilence equals death\nSilence Death\n...\nACT UP\n")
    rows = files.lexicon(spark, str(tmp_path / "l.txt")).orderBy("pos").collect()
    assert [(r["term"], r["words"]) for r in rows] == [("Silence = Death", ["silence", "equals", "death"]), ("Silence Death", ["silence", "death"]), ("ACT UP", ["act", "up"])]


def test_wav_of_all_widths(spark, tmp_path):
    for width, data in ((1, bytes([0, 128, 255])), (2, b"\x00\x80\x00\x00\x00\x40"), (3, b"\x00\x00\x80\x00\x00\x00\x00\x00\x40"), (4, b"\x00\x00\x00\x80\x00\x00\x00\x00\x00\x00\x00\x40")):
        with wave.open(str(tmp_path / f"{width}.wav"), "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(width)
            w.setframerate(8000)
            w.writeframes(data)
    got = {r["file"][-5]: (r["rate"], r["channels"], r["samples"]) for r in files.wav(spark, str(tmp_path)).collect()}
    assert got == {"1": (8000, 1, [-1.0, 0.0, 127 / 128]), **{w: (8000, 1, [-1.0, 0.0, 0.5]) for w in "234"}}


def test_vector_parameters_and_names(spark):
    rows = spark.createDataFrame([("Größe über alles hinaus", [0.5, -1.0]), ("one", None), ("", [1.0])], "t string, v array<double>")
    got = [r[0] for r in rows.select(sinks.vector_parameter(F.col("t"), F.col("v"), 2)).collect()]
    assert got == [":param größeÜberAllesEmbedding => vector([0.5, -1.0], 2, FLOAT64);", None, ":param Embedding => vector([1.0], 2, FLOAT64);"]


def test_diagnostic_and_best_names(spark):
    ship(spark)
    rows = spark.createDataFrame([(1, 0, [3.0, 4.0], "a"), (1, 1, [3.0, 4.0], "a"), (1, 2, [-4.0, 3.0], "b"), (2, 0, [1.0, 0.0], "a")], "rec int, i int, v array<double>, who string")
    got = {r["rec"]: r for r in speakers.diagnostic(rows, ["rec"], "i", "v", "who").collect()}
    assert (got[1]["vectors"], got[1]["mean_norm"], got[1]["same_pairs"], got[1]["other_pairs"], got[1]["same_distance"], got[1]["other_distance"]) == (3, 5.0, 1, 2, 0.0, 1.0)
    assert (got[2]["vectors"], got[2]["same_pairs"], got[2]["same_distance"]) == (1, 0, None)
    cases = spark.createDataFrame([(["S0", "S1"], ["x", "y"], [("S0", "y", 5), ("S1", "y", 6), ("S1", "x", 4)]), (["S0", "S1"], ["x"], [("S0", "x", 1)]), ([], ["x"], []), (["S0", "S1"], ["x", "y", "z"], [("S0", "y", 2), ("S0", "x", 2), ("S1", "x", 2), ("S1", "y", 2)]), (["S0"], ["x"], [(None, "x", 3)])], "l array<string>, n array<string>, t array<struct<label:string,name:string,n:long>>")
    assert [r[0] for r in cases.select(speakers.best_names("l", "n", "t")).collect()] == [{"S0": "y", "S1": "x"}, {}, {}, {"S0": "x", "S1": "y"}, {}]


def test_members_by_plain_words_and_by_pattern(spark):
    texts = ["of the", "of \n\t the", "of\u00a0the", "xof the", "of thex", "of_ the of the_", "é" + "of the" + "é", "ofthe of  the.", None, "", " ", "A.B a+b", "AxB", "A.B_", "the of\r", "of the\u2028"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    roster = corpus.members(docs, "doc_id", ["of the", "of", "A.B", "x?of the"])
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" in plan(roster) and "regexp_replace" not in plan(corpus.members(docs, "doc_id", ["of the", "of"]))  # plain words need no flattened text
    flat = [re.sub("[ \t\r\n\f]+", " ", t or "").strip(" ") for t in texts]
    want = {(i, g) for i, t in enumerate(flat) for g in ("of the", "of", "A.B", "x?of the") if re.search(f"(^|[^A-Za-z0-9_])(?:{g})($|[^A-Za-z0-9_])", t)}
    assert {tuple(r) for r in roster.collect()} == want and roster.count() == len(want)


def test_totals_of_plain_words_need_no_flattened_text(spark):
    docs = spark.createDataFrame([(1, "a of the b"), (1, "of the"), (2, "the"), (3, None)], "doc_id int, text string")
    totals = corpus.roster_totals(corpus.members(docs, "doc_id", ["of the", "the"]), "doc_id")
    assert "regexp_replace" not in totals._jdf.queryExecution().optimizedPlan().toString()
    assert tuple(totals.first()) == (5, 2, 2)


def test_normalized_makes_no_map_for_each_token(spark):
    ship(spark)
    rng = random.Random(7)
    parts = ["n", "t", " ", " ", "i", "s", "é", "😀", "'", "a", "you", "don", " n t", "n t", "i m", "😀a", "we ", "-", "cannot", "=", "7", "1999", *"\n\t\x0b\x0c\r\x1c\x1f\x85\xa0\u1680\u2005\u2028\u202f\u205f\u3000\u200b"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(1500)]
    rows = normal.normalized(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text")
    assert "map_from_arrays" not in rows._jdf.queryExecution().optimizedPlan().toString()
    got = {r["i"]: r["tokens"] for r in rows.collect()}
    assert [got[i] for i in range(len(texts))] == [normalize_text(t) for t in texts]


def test_patterns_of_plain_words_begin_with_a_word(spark):
    rng = random.Random(12)
    names = ["of the", "of", "ofof", "😀 of", "😀", "é", "-", "the"]
    parts = ["of", "the", "ofof", " ", " ", "\n", "\t \r", "\u00a0", "_", "x", "é", "😀", "-", "7", ".", "𝒳"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 12))) for _ in range(2500)] + ["of", "of the", None]
    roster = corpus.members(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), "doc_id", names)
    totals = corpus.roster_totals(roster, "doc_id")
    for df in (roster, totals):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "of(?<!" in plan and "(?<![A-Za-z0-9_])" not in plan  # a look back at each place of a text costs several times as much
    flat = [re.sub("[ \t\r\n\f]+", " ", t or "").strip(" ") for t in texts]
    want = {(i, g) for i, t in enumerate(flat) for g in names if re.search(f"(^|[^A-Za-z0-9_])(?:{re.escape(g)})($|[^A-Za-z0-9_])", t)}
    assert {tuple(r) for r in roster.collect()} == want and len(want) > 1000
    assert tuple(totals.first()) == (len(want), len({i for i, _ in want}), len({g for _, g in want}))
