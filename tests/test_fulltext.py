"""Stems of the published examples, and searches against a plain reading of the same documents."""

import re

import pytest
from pyspark.sql import functions as F

from talespan.functions.stem import porter
from talespan.operators import fulltext
from talespan.runtime import ship

STEMS = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll".split()


def test_published_stems():
    assert {w: porter(w) for w in STEMS[::2]} == dict(zip(STEMS[::2], STEMS[1::2]))
    assert [porter(w) for w in ("", "a", "is", "größe", "x1s")] == ["", "a", "is", "größe", "x1s"]


DOCS = [
    (1, "The activists marched; marching activists' signs said Silence = Death."), (2, "She was an activist and he marches on."), (3, "Death of silence, the silence of the death"), (4, None), (5, ""),
    (6, "Größe und Stärke: café-crème don't"), (7, "silence silence silence " * 30), (8, "the and of"), (9, "Activism activates active action."), (10, "signs of death in silence"),
]


def terms_of(text):
    words = [re.sub("['’]s$", "", w) for w in re.findall(r"[^\W_]+(?:['’][^\W_]+)*", (text or "").lower())]
    return {i: porter(w) for i, w in enumerate(words) if w not in fulltext.STOP_WORDS}


TERMS = {d: terms_of(t) for d, t in DOCS}
has = lambda w: {d for d, t in TERMS.items() if porter(w) in t.values()}
starts = lambda p: {d for d, t in TERMS.items() if any(x.startswith(p) for x in t.values())}
row = lambda *ws: {d for d, t in TERMS.items() if any(all(t.get(i + o) == porter(w) for o, w in ws) for i in t)}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("activist", has("activist")), ("marched AND activists", has("march") & has("activist")), ("silence death", has("silence") | has("death")), ("silence NOT death", has("silence") - has("death")),
        ("-silence +death", has("death") - has("silence")), ('"silence death"', row((0, "silence"), (1, "death"))), ('"silence of the death"', row((0, "silence"), (3, "death"))), ('"signs of death in silence"', {10}), ("activ*", starts("activ")), ("march* AND (sign OR café)", starts("march") & (has("sign") | has("café"))),
        ("NOT silence", set()), ("the", set()), ("", set()), ("größe AND don't", {6}), ('"unclosed death', set()), ("death AND NOT (sign OR march)", has("death") - has("sign") - has("march")), ("((silence)", has("silence")),
    ],
)
def test_searches(spark, text, want):
    ship(spark)
    docs = spark.createDataFrame(DOCS, "doc_id int, text string").repartition(2)
    got = {r["doc_id"]: r["score"] for r in fulltext.search(docs, text).collect()}
    assert set(got) == want and all(s > 0 for s in got.values())


def test_rarer_and_more_frequent_terms_score_more(spark):
    ship(spark)
    docs = spark.createDataFrame(DOCS, "doc_id int, text string")
    got = {r["doc_id"]: r["score"] for r in fulltext.search(docs, "silence OR activism").collect()}
    assert got[9] > got[1] and got[3] > got[10]


def test_queries_share_one_pass_over_the_texts(spark):
    ship(spark)
    docs = spark.createDataFrame(DOCS + DOCS[:1], "doc_id int, text string").repartition(2)
    texts = ["silence", "", "activist AND marched", '"silence death" OR activ*', "NOT silence", "death NOT silence", "silence"]
    found = fulltext.searches(docs, texts)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 1  # the queries' words; texts are read before
    want = {(r["query"], r["doc_id"], r["score"]) for q in texts for r in fulltext.search(docs, q).withColumn("query", F.lit(q)).collect()}
    assert {(r["query"], r["doc_id"], r["score"]) for r in found.collect()} == want
    assert found.count() == len(want)


def test_plain_words_and_prefixes(spark):
    docs = spark.createDataFrame(DOCS, "doc_id int, text string")
    got = fulltext.searches(docs, ["signs OR größe", "activ*", '"of the"', "and -marches"], analyzer=fulltext.Analyzer(english=False)).collect()
    assert {q: {r["doc_id"] for r in got if r["query"] == q} for q in {r["query"] for r in got}} == {"signs OR größe": {1, 6, 10}, "activ*": {1, 2, 9}, '"of the"': {3}, "and -marches": {8}}
