"""Each stage of the pipeline against plain versions, on what its predecessor kept."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from talespan.llm import perplexity
from tests.llm import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rng = random.Random(17)
    vocabulary = [f"w{i}" for i in range(900)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    item, passage, texts = prose(30), prose(60), []
    for _ in range(60):
        texts.append(prose(rng.randrange(20, 200)))
    base = texts[3].split()
    texts += [texts[3], " ".join([*base[:10], "changed", *base[11:]]), prose(40) + " " + passage, passage + "\n" + prose(50), item, prose(10) + " " + item, prose(900) + " " + item + " " + prose(20)]
    texts += [None, "", "one two", *(" ".join(f"{rng.random()}" for _ in range(80)) for _ in range(6))]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, 1, 0) for i in range(60)]
    return [*rows, rows[5], (None, prose(30), None, None, None)], labels, [(1, item), (2, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows, labels, items = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def stage(spark, name, docs, folder):
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, folder)
    path = f"{folder}/{name.replace(' ', '_')}"
    out.write.parquet(path)
    return spark.read.parquet(path)


def pairs(frame):
    return [(r["doc_id"], r["text"]) for r in frame.collect()]


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = pairs(docs)

    kept = stage(spark, "quality classifier", docs, folder)
    assert kept.columns == COLUMNS
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    verdict = {r["doc_id"]: r["kept"] for r in perplexity.verdicts(docs, labels).collect()}
    after = pairs(kept)
    order = lambda rows: sorted(rows, key=str)
    assert order(after) == order(x for x in before if verdict[x[0]])
    assert {d for d, ok in verdict.items() if not ok} == set(range(70, 76))  # the documents of made-up numbers

    single = stage(spark, "n-gram Jaccard join", kept, folder)
    assert single.columns == COLUMNS
    group = brute.links([(-1 if d is None else d, t) for d, t in after])
    before, after = after, pairs(single)
    # the repeated row stays once
    assert len(before) > len(set(before)) and order(after) == order({x for x in before if group[-1 if x[0] is None else x[0]][1] == (-1 if x[0] is None else x[0])})

    cut = stage(spark, "substring dedup", single, folder)
    assert cut.columns == COLUMNS
    want = brute.substrings([(-1 if d is None else d, t) for d, t in after])
    before, after = after, pairs(cut)
    assert order(after) == order((d, want[-1 if d is None else d][2] if want[-1 if d is None else d][1] else t) for d, t in before)
    assert any(g for _, g, _ in want.values())

    clean = stage(spark, "benchmark decontamination", cut, folder)
    assert clean.columns == COLUMNS
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    before, after = after, pairs(clean)
    found = brute.contamination([(-1 if d is None else d, t) for d, t in before], items)
    assert {d for d, _ in after} == {d for d, _ in before if not found[-1 if d is None else d][3]}
    untouched = {d for d, _ in before if not found[-1 if d is None else d][1]}
    assert order(x for x in after if x[0] in untouched) == order(x for x in before if x[0] in untouched)
    assert not any(v[1] for v in brute.contamination([(-1 if d is None else d, t) for d, t in after], items).values())

    packed = stage(spark, "lexical packing", clean, folder).collect()
    tokens = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {d: np.array([*tokens.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for d, t in after if d != 5}
    windows, seen = defaultdict(list), defaultdict(int)
    for p in packed:
        windows[p["sequence_id"]].append((p["offset"], p["length"]))
        if p["doc_id"] in ids:
            own = ids[p["doc_id"]]
            assert p["doc_tokens"] == len(own) and zlib.crc32(own[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"]
            seen[p["doc_id"]] += p["length"]
    assert dict(seen) == {d: len(x) for d, x in ids.items()}
    for parts in windows.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 2048


def test_stages_let_their_shuffle_files_go(spark, folder, monkeypatch):
    """Before a stage begins, those of its predecessors are released."""
    seen, stub = [], lambda name: lambda spark, docs, sf_dir: (seen.append(name), docs)[1]
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", stub("a")), ("b", stub("b"))])
    monkeypatch.setattr(corpus_pipeline, "release", lambda spark: seen.append("release"))
    corpus_pipeline.run(spark, folder)
    assert seen[:3] == ["a", "release", "b"]


def test_run_and_empty_tables(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 0
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_long_texts_and_clashing_columns(spark, folder, tmp_path):
    """Extra columns with the operators' own names pass all filters, and a very long text is handled whole."""
    extra = ["id", "crc", "half", "size", "print", "block", "kept", "n_words", "component_id", "lexical", "part", "n", "log", "language", "sets"]
    rows, labels, items = corpus()
    long = (5000, " ".join(f"w{i * 7 % 900}" for i in range(120_000)), "en", "s", 1)
    frame = spark.createDataFrame([(*r, *(["clash"] * len(extra))) for r in [*rows, long]], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra))
    docs, path = frame.repartition(3), str(tmp_path)
    for i, (name, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, folder).write.parquet(f"{path}/{i}")
        docs = spark.read.parquet(f"{path}/{i}")
        if i < 4:
            assert docs.columns == frame.columns, name
            assert all(r[c] == "clash" for r in docs.select(*extra).collect() for c in extra)
    packed = [r for r in docs.collect() if r["doc_id"] == 5000]
    assert not packed or sum(r["length"] for r in packed) == packed[0]["doc_tokens"] > 100_000
