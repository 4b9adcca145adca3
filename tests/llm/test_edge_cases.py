"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import json
import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from talespan.llm import attribution, chat, decontaminate, near_duplicates, packing, perplexity, planes, quality_rules, substring_dedup, token_store, toxicity
from talespan.llm.tokens import Encoder, pieces
from tests.llm import brute

RNG = random.Random(5)
VOCAB = ["the", "of", "and"] + ["".join(RNG.choice("abcdeéß") for _ in range(4)) for _ in range(300)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _n_words string, component_id long, score double"


def prose(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


def corpus():
    base, passage, item = prose(120), prose(60), prose(30)
    w = base.split()
    texts = [base, base, " ".join([*w[:60], "changed", *w[61:]]), base.upper(), None, "", " \n\t ", "one two", "One  TWO\n", "one", prose(40) + " " + passage + " " + prose(40), passage + "\n" + prose(50), prose(9000) + " " + passage, "a b " * 40, item, prose(10) + " " + item + " " + prose(10), prose(1500) + " " + item, "x\0y é ́ z   w", *(" ".join([*w[:k], prose(3), *w[k + 3 :]]) for k in range(0, 110, 8)), *(prose(RNG.randrange(1, 9)) for _ in range(20))]
    order = list(range(len(texts)))
    RNG.shuffle(order)
    return [(i, texts[o]) for i, o in enumerate(order)], [(1, item), (10, item), (2, prose(20)), (3, "one two"), (4, None), (5, "")]


ROWS, ITEMS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, RNG.choice(["en", "de", None]), "s", len(t or ""), "clash", 7, 0.5) for i, t in ROWS], DOCS).repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("block_words", [1, 10**6])
def test_decontamination(docs, items, block_words):
    want = brute.contamination(ROWS, ITEMS)
    rows = decontaminate.scan(docs.select("doc_id", "text"), items, block_words=block_words).collect()
    got = {r["doc_id"]: (r["__talespan_n_words"], sum(s["stop"] - s["start"] for s in r["__talespan_spans"]), list(r["__talespan_items"])) for r in rows}
    assert got == {d: v[:3] for d, v in want.items()}
    verdict = {r["doc_id"]: (r["contaminated"], r["items_sha256"]) for r in decontaminate.verdicts(docs, items).collect()}
    assert verdict == {d: (v[3], hashlib.sha256(",".join(v[2]).encode()).hexdigest()) for d, v in want.items()}
    cleaned = {r["doc_id"]: r["text"] for r in decontaminate.clean(docs, items).collect()}
    assert set(cleaned) == {d for d, v in want.items() if not v[3]}
    assert all(cleaned[d] == t for d, t in ROWS if d in cleaned and not want[d][1])
    after = brute.contamination(list(cleaned.items()), [(i, t) for i, t in ITEMS if i != 3])
    assert not any(v[1] for v in after.values())


def test_long_items_are_cut_and_large_benchmarks_refused(spark, docs, monkeypatch):
    """Pieces of an item keep all its windows; a benchmark beyond the bound is an error, not a part of itself."""
    passages = prose(900)
    w = passages.split()
    texts = [(i, prose(5) + " " + " ".join(w[a : a + 20]) + " " + prose(5)) for i, a in enumerate(range(0, 880, 7))] + [(999, passages)]
    items = [(1, passages), (2, " ".join(w[100:112])), (3, prose(15))]
    got = decontaminate.scan(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_words=50).collect()
    want = brute.contamination(texts, items)
    assert {r["doc_id"]: (r["__talespan_n_words"], sum(s["stop"] - s["start"] for s in r["__talespan_spans"]), list(r["__talespan_items"])) for r in got} == {d: v[:3] for d, v in want.items()}
    monkeypatch.setattr(decontaminate, "MAX_WORDS", 100)
    with pytest.raises(ValueError, match="limit"):
        decontaminate.verdicts(docs, spark.createDataFrame(items, "item_id long, text string"))


def test_near_duplicates(docs):
    want = brute.links(ROWS)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates.classes(docs).collect()}
    assert got == want
    kept = {r["doc_id"] for r in near_duplicates.one_of_each(docs).collect()}
    assert kept == {d for d, v in want.items() if v[1] == d}
    assert near_duplicates.one_of_each(docs).columns == docs.columns


def test_repeated_rows_stay_once(spark):
    rows = [(1, "a b c", 7), (1, "a b c", 7), (1, "a b c", 8), (2, None, 1), (2, None, 1), (2, "", 1), (None, "x", 1), (None, "x", 1), (None, "y", 1), (3, "z", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int").repartition(3)
    got = near_duplicates.one_of_each(docs).collect()
    assert sorted(str((r["doc_id"], r["text"] or "")) for r in got) == sorted(map(str, [(1, "a b c"), (2, ""), (3, "z"), (None, "x"), (None, "y")]))
    assert near_duplicates.one_row_each(docs.limit(0)).count() == 0


def test_packing_refuses_wide_ids(docs, tmp_path):
    from tokenizers import Tokenizer, models

    Tokenizer(models.WordLevel({f"w{i}": i for i in range(70_000)}, "w0")).save(str(tmp_path / "wide.json"))
    with pytest.raises(ValueError, match="16 bits"):
        packing.rests(docs, str(tmp_path / "wide.json"))


def test_near_duplicates_random_families(spark):
    rng, rows = random.Random(11), []
    for f in range(14):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 12, 30, 80]))]
        for _ in range(rng.choice([1, 3, 12])):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 10)):
                own[rng.randrange(len(own))] = f"z{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.links(rows)


def linked_pair(rng, hot, largest):
    n = int(rng.integers(1, largest))
    common = np.unique(np.concatenate((rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2), hot[: int(rng.integers(0, 20))])))
    extra = int(len(common) / 3)
    a = int(rng.integers(0, extra + 1))
    return [np.unique(np.concatenate((common, rng.integers(0, 1 << 63, k).astype(np.uint64)))) for k in (a, extra - a)]


def likeness(x, y):
    return len(np.intersect1d(x, y)) / max(len(np.union1d(x, y)), 1)


def test_signatures_of_linked_sets_meet():
    rng = np.random.default_rng(2)
    hot = np.sort(rng.integers(0, 1 << 63, 50).astype(np.uint64))
    for k in range(800):
        x, y = linked_pair(rng, hot, 90 if k % 6 else 2000)
        if likeness(x, y) >= 0.75:
            values, doc = near_duplicates.signatures([x, y], hot, (near_duplicates.COARSE, near_duplicates.FINE)[k % 2])
            assert len(np.intersect1d(values[doc == 0], values[doc == 1])), (len(x), len(y))


def test_signatures_hold_several_shingles():
    """A signature is a subset of partitions, so documents that share a few shingles have few signatures in common."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64) * np.uint64(2)) for _ in range(2)]
    values, _ = near_duplicates.signatures(sets[:1], sets[0][:0])
    assert len(values) < 2 * 300
    mixed = np.unique(np.concatenate((sets[0][::3], sets[1])))
    values, doc = near_duplicates.signatures([sets[0], mixed], sets[0][:0])
    assert len(np.intersect1d(values[doc == 0], values[doc == 1])) < 20


@pytest.mark.parametrize("blocks", [1, 5])
def test_substrings(docs, blocks, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BATCH_BYTES", 4000)
    want = brute.substrings(ROWS)
    found = substring_dedup.digests(docs).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found} == {d: (n, g, hashlib.sha256(t.encode()).hexdigest()) for d, (n, g, t) in want.items()}
    out = {r["doc_id"]: r["text"] for r in substring_dedup.cut(docs).collect()}
    assert all(out[d] == (want[d][2] if want[d][1] else t) for d, t in ROWS)


def test_factors_copy_their_sources(docs):
    """Every factor's words stand in its source at its place, sources are earlier, and factors cover what is removed."""
    words = {d: brute.SPACE.findall(t or "") for d, t in ROWS}
    want, seen = brute.substrings(ROWS), 0
    for r in substring_dedup.spans(docs).collect():
        own, covered = words[r["doc_id"]], set()
        for f in r["factors"]:
            assert f["source"] < r["doc_id"] and f["stop"] - f["start"] >= substring_dedup.SPAN
            assert own[f["start"] : f["stop"]] == words[f["source"]][f["source_start"] :][: f["stop"] - f["start"]]
            covered |= set(range(f["start"], f["stop"]))
            seen += 1
        assert len(covered) == want[r["doc_id"]][1]
    assert seen > 10


def test_repeated_ids(spark):
    rows = [(3, "a b c d e f g h i j k l m n"), (3, "a b c d e f g h i j k l m n"), (None, "a b c d e f g h i j k l m q"), (9, "z a b c d e f g h i j k l m n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in substring_dedup.digests(df).collect())
    assert got == [("3", 13), ("3", 13), ("9", 14), ("None", 0)]
    assert near_duplicates.classes(df).count() == 4
    assert decontaminate.verdicts(df, spark.createDataFrame([], "item_id long, text string")).count() == 4


def test_token_pieces_equal_whole_texts():
    texts = [t for _, t in ROWS] + ["a  b", "\n\na b\t c", "x<|endoftext|> y", "it's 'll we", " lead", "trail ", "12 345 a-b", "A\x1c b", "½. x², a1. ǅ! ·. é: ١."]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        whole = Tokenizer.from_file(P.path(name))
        want = [whole.encode(t or "", add_special_tokens=False) for t in texts]
        for limit in (10, 10**6):
            assert [np.frombuffer(b, "<u4").tolist() for b in Encoder(P.path(name), cache_pieces=limit).encode(texts)] == [w.ids for w in want]
        assert [[tuple(x) for x in o.tolist()] for o in Encoder(P.path(name), with_offsets=True).offsets(texts)] == [w.offsets for w in want]
    assert pieces("a b")[0] == "\0a"


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_pieces_of_random_texts(name):
    draw = random.Random(11)
    parts = [" ", " ", " ", "\n", "\n\n", "  ", " \n", "\t", "\x85", "\xa0", "\u2003", "\x1f", "word", "Été", "Ünïq", "ŉ", "İ", "ß", "ſ", "ǆ", "Σς", "e\u0301", "\u0301", "a", "it's", "'ll", "'", "...", "%%%", "<|", "<|endoftext|>", "12", "½", "x²", "日本", "-", ">", "&&&", "\0"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(1, 30))) for _ in range(1500)]
    whole = Tokenizer.from_file(P.path(name))
    want = [whole.encode(t, add_special_tokens=False) for t in texts]
    assert [np.frombuffer(b, "<u4").tolist() for b in Encoder(P.path(name)).encode(texts)] == [w.ids for w in want]
    assert [[tuple(x) for x in o.tolist()] for o in Encoder(P.path(name), with_offsets=True).offsets(texts)] == [w.offsets for w in want]


def test_a_file_with_other_rules_gets_whole_texts(tmp_path):
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        rules = json.load(file)
    rules["pre_tokenizer"]["use_regex"] = False  # then a pretoken reaches across spaces
    (tmp_path / "other.json").write_text(json.dumps(rules))
    own, whole = Encoder(str(tmp_path / "other.json")), Tokenizer.from_file(str(tmp_path / "other.json"))
    assert own.whole and not Encoder(P.path("byte_bpe_50k.json")).whole
    texts = ["of the people", "", None, "a  b"]
    assert [np.frombuffer(b, "<u4").tolist() for b in own.encode(texts)] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("bits", [False, True])
def test_token_store(docs, spark, tmp_path, bits):
    path = str(tmp_path / "ids")
    token_store.write(docs, path, P.path("byte_bpe_50k.json"), block_ids=100, chunk_ids=500, bits=bits)
    whole, at = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0
    got = {r["doc_id"]: tuple(r)[1:] for r in token_store.read(spark, path, bits).collect()}
    for d, t in sorted(ROWS):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert got[d] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_planes_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 1000):
        x = rng.integers(0, 1 << 32, n).astype(np.uint32)
        for bits in (False, True):
            assert (planes.unpack(planes.pack(x, bits), np.uint32, bits)[0] == x).all()
        s = np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64))
        assert (planes.unpack_sorted(planes.pack_sorted(s))[0] == s).all()


def test_packing(docs):
    whole = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {d: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for d, t in ROWS}
    rows = packing.pack(docs, P.path("word_bpe_49k.json"), window=256, block_rests=8).collect()
    at = dict.fromkeys(ids, 0)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(ids[r["doc_id"]])
        at[r["doc_id"]] += r["length"]
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : at[r["doc_id"]]].tobytes())
    assert at == {d: len(i) for d, i in ids.items()}
    windows = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == windows.get(r["sequence_id"], 0)
        windows[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(windows.values()) <= 256 and sum(v < 256 for v in windows.values()) <= 4


def test_packing_searches_the_whole_shard(spark):
    """All windows equal a plain greedy search over all rests, however few rests are dropped at once."""
    rng = random.Random(17)
    texts = [" ".join(rng.choice(VOCAB) for _ in range(rng.randrange(3, 60))) for _ in range(90)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path, window = P.path("word_bpe_49k.json"), 128
    rests = sorted(((r["lexical"], r["doc_id"], np.frombuffer(r["rest"], "<u2"), r["doc_tokens"]) for r in packing.rests(df, path, window).collect()), key=lambda r: r[:2])
    rests = [r for r in rests if len(r[2])]
    n, mean = len(rests), np.mean([len(r[2]) for r in rests])
    sets = [set(r[2].tolist()) for r in rests]
    df_of = {t: sum(t in s for s in sets) for t in set().union(*sets)}
    counted = packing.statistics(packing.rests(df, path, window))
    assert counted[0] == n and abs(counted[2] - mean) < 1e-9 and all(counted[1][t] == k for t, k in df_of.items()) and counted[1].sum() == sum(df_of.values())

    def score(seed, d):
        ids = rests[d][2].tolist()
        return sum(np.log1p((n - df_of[t] + 0.5) / (df_of[t] + 0.5)) * ids.count(t) * 2.2 / (ids.count(t) + 1.2 * (0.25 + 0.75 * len(ids) / mean)) for t in sets[seed] & sets[d])

    used, want = [0] * n, []
    for seed in range(n):
        while used[seed] < len(rests[seed][2]):
            room = window
            for d in [seed, *sorted((d for d in range(n) if d != seed), key=lambda d: (-round(score(seed, d), 9), d))]:
                if room and (k := min(len(rests[d][2]) - used[d], room)):
                    want.append((rests[d][1], rests[d][3] - len(rests[d][2]) + used[d], k))
                    used[d], room = used[d] + k, room - k
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        for block in (4, 512):
            rows = sorted(packing.pack(df, path, window=window, block_rests=block).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
            full = {r["sequence_id"] for r in rows if r["length"] == window and r["start"] + window <= r["doc_tokens"] // window * window}
            assert [(r["doc_id"], r["start"], r["length"]) for r in rows if r["sequence_id"] not in full] == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_bm25_scores():
    block = [np.array(x) for x in ([1, 2, 2, 3], [2, 3], [9, 9, 9])]
    index = packing.Index(block)
    for seed in range(3):
        want = []
        for d in block:
            s = 0.0
            for t in set(block[seed].tolist()):
                df = sum(t in b for b in block)
                tf = int((d == t).sum())
                s += np.log1p((3 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / 3)) if tf else 0.0
            want.append(s)
        assert np.allclose(index.scores(seed), want)


def half(doc):
    return zlib.crc32(str(perplexity.FIRST_ID if doc is None else doc).encode()) % perplexity.HALVES


@pytest.mark.parametrize("blocks", [1, 3, 40])
def test_perplexity_and_thresholds_equal_definition(spark, blocks, monkeypatch):
    """One shard; contexts in shards of their own; so many shards that most contexts are hot and dealt over all."""
    monkeypatch.setattr(perplexity, "BATCH_BYTES", 3000)
    rng = random.Random(3)
    vocabulary = ["the", "of", *(f"w{i}" for i in range(60))]
    text = lambda: " ".join(rng.choice(vocabulary[: rng.choice([5, 62])]) for _ in range(rng.randrange(1, 40)))
    rows = [(i, text(), rng.choice(["a", "b", None])) for i in range(260)] + [(900, None, "a"), (901, "", "b"), (902, "###  $$$ qq", "b"), (None, "the of", "a"), (5, "the w1", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0, 0) for i in range(240)], "doc_id long, quality int, toxic int")
    good = {i for i in range(240) if i % 3}
    models = [brute.kneser_ney([t for d, t, _ in rows if d in good and half(d) == k]) for k in range(2)]
    logs = [(d, t, lang or "", *brute.log_probability(models[1 - half(d)], t)) for d, t, lang in rows]
    sets = [x for x in logs if x[0] in good and x[4]]
    total = lambda some: sum(x[3] for x in some) / sum(x[4] for x in some)
    mean = {lang: total(some) for lang in {x[2] for x in sets} if (some := [x for x in sets if x[2] == lang])}
    entropy = lambda x: -(x[3] + perplexity.PRIOR_WORDS * mean.get(x[2], total(sets))) / (x[4] + perplexity.PRIOR_WORDS) if x[4] else None
    cut = lambda some: np.quantile([math.ceil(entropy(x) * 100) for x in some], perplexity.QUANTILE) / 100
    own = {lang: cut(some) for lang in mean if len(some := [x for x in sets if x[2] == lang]) >= perplexity.LEAST_TRUSTED}
    want = sorted((-1 if x[0] is None else x[0], round(math.exp(entropy(x)), 3) if x[4] else 0.0, round(math.exp(own.get(x[2], cut(sets))) * perplexity.MARGIN, 3)) for x in logs)
    found = perplexity.judged(docs, labels, blocks=blocks).collect()
    got = sorted((-1 if r["id"] == perplexity.FIRST_ID else r["id"], round(r["perplexity"], 3), round(r["threshold"], 3)) for r in found)
    assert len(got) == len(want)
    assert all(g[0] == w[0] and abs(g[1] - w[1]) <= 2e-3 * w[1] and abs(g[2] - w[2]) <= 0.02 * w[2] for g, w in zip(got, want, strict=True)), [x for x in zip(got, want, strict=True) if x[0] != x[1]][:3]
    assert all(r["kept"] == (r["perplexity"] <= r["threshold"]) for r in found)


def test_quality_classifier(docs, spark):
    labels = spark.createDataFrame([(d, 1, 0) for d, _ in ROWS[::2]] + [(ROWS[1][0], 0, 1), (None, None, None)], "doc_id long, quality int, toxic int")
    rows = perplexity.verdicts(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(r["kept"] for r in rows if r["perplexity"] == 0.0)
    none = spark.createDataFrame([], labels.schema)
    assert all(r["kept"] for r in perplexity.verdicts(docs, none).collect())
    assert perplexity.keep(docs, labels).columns == docs.columns


def test_junk_is_rejected(spark):
    """Trusted prose in one language; long texts of unknown words go, prose that was not counted stays."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(40)]
    prose_ = lambda: " ".join(rng.choice(vocabulary) for _ in range(60))
    junk = lambda: " ".join(f"{rng.random()}" for _ in range(60))
    rows = [(i, prose_() if i < 400 else junk(), "a") for i in range(440)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in perplexity.keep(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels).collect()}
    assert not kept & set(range(400, 440)) and len(kept & set(range(300, 400))) >= 98


def test_nearest_is_exact():
    rng = np.random.default_rng(3)
    words = [f"t{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 9))).encode() for _ in range(400)]
    toxic = rng.integers(0, 2, 400)
    from talespan.llm.words import Words, byte_table

    vocabulary = np.unique(Words(texts, byte_table("alnum-lower")).hashes)
    index = toxicity.Index(texts, toxic, vocabulary, np.linspace(1, 2, len(vocabulary)))
    doc, term, weight = index.rows
    dense = np.zeros((400, len(vocabulary)))
    dense[doc, term] = weight
    for i in range(0, 400, 37):
        own = doc == i
        best, score = index.nearest(term[own], weight[own], 10)
        assert np.allclose(score, np.sort(dense @ dense[i])[::-1][:10])
        assert np.allclose(dense[best] @ dense[i], score)


def test_toxicity_learns_only_from_its_folds(spark):
    bad = ["vile", "nasty"]
    rows = [(i, prose(20) + (" " + bad[i % 2] if i % 3 == 0 else "")) for i in range(300)] + [(1000, None), (1001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    right = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    wrong = spark.createDataFrame([(i, int(i % 3 == 0) ^ int(zlib.crc32(str(i).encode()) % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    a, b = (sorted(tuple(r)[:4] for r in toxicity.scores(df, x).collect()) for x in (right, wrong))
    assert a == b and all(0 <= r[2] <= 1 and r[3] == int(r[2] >= 0.5) for r in a)
    held = [r for r in a if r[1] and r[0] < 1000]
    assert np.mean([r[3] == int(r[0] % 3 == 0) for r in held]) > 0.95
    assert len(toxicity.scores(df, spark.createDataFrame([], "doc_id long, toxic int")).collect()) == 302
    near = [e for r in toxicity.scores(df, right).collect() for e in r["evidence"]]
    assert near and all(e["toxic"] == int(e["doc_id"] % 3 == 0) and zlib.crc32(str(e["doc_id"]).encode()) % 5 for e in near)


def test_toxicity_does_not_depend_on_the_bound(spark):
    """A sample of which one label is cut, by its bound or by repeated rows, has the scores of the whole one."""
    rng = random.Random(11)
    # "sharp" is in most toxic texts and some others: its share depends on the labels' ratio
    bad = {i: rng.random() < 0.1 for i in range(3000)}
    rows = [(i, f"plain words {i % 7}" + (" sharp" if rng.random() < (0.8 if bad[i] else 0.1) else "")) for i in bad]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(b)) for i, b in bad.items()], "doc_id long, toxic int")
    whole, cut = ({r["doc_id"]: r["score"] for r in toxicity.scores(df, labels, each).collect()} for each in (4000, 260))
    for has in (True, False):
        ids = [i for i, t in rows if ("sharp" in t) == has]
        a, b = (np.mean([s[i] for i in ids]) for s in (whole, cut))
        share = np.mean([bad[i] for i in ids])
        assert abs(a - b) < 0.08 and abs(b - share) < 0.1
    clean = [i for i, b in bad.items() if not b and zlib.crc32(str(i).encode()) % 5]
    again = df.unionByName(df.where(df.doc_id.isin(clean[:40])).crossJoin(spark.range(60)).select("doc_id", "text"))
    texts, toxic, stands_for, names = toxicity.examples(again, labels, 260)
    assert [bad[i] for i in names] == toxic.astype(bool).tolist()
    train = [i for i in bad if zlib.crc32(str(i).encode()) % 5]
    assert toxic.sum() == sum(bad[i] for i in train) and stands_for[1] == 1
    assert len(texts) - toxic.sum() <= 520 and stands_for[0] > 1


def test_attribution(docs):
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = attribution.counts(docs, P.path("byte_bpe_50k.json")).collect()
    total = {}
    for r in rows:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
    assert total == {d: len(whole.encode(t or "", add_special_tokens=False).ids) for d, t in ROWS}
    spans, starts = np.array([[0, 3], [3, 9], [9, 10]]), np.array([0, 5, 8])
    assert attribution.allocate(spans, starts, 12, "most")[0].tolist() == [0, 1, 2]
    assert attribution.allocate(spans, starts, 12, "first")[0].tolist() == [0, 0, 2]
    assert attribution.allocate(spans, starts, 12, "last")[0].tolist() == [0, 2, 2]
    assert attribution.section_starts("a\n\nb\n").tolist() == [0, 2, 3]


def test_chat(spark):
    rows = [(1, 0, "system", "be nice"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (2, 0, None, "x"), (None, 0, "eve", "yo")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.rotations(df).collect()
    assert len(got) == 4 * 2 + 1
    for r in got:
        if r["is_target"]:
            assert r["rendered"].startswith("<|im_start|>assistant\n") and r["rendered"][r["mask_start"] : r["mask_stop"]].endswith("<|im_end|>")
        else:
            assert r["mask_start"] == r["mask_stop"] == -1
    for d in chat.dialogues(df).collect():
        assert all(d["text"][m["start"] : m["stop"]].endswith("<|im_end|>") for m in d["masks"])


def test_quality_rules(docs):
    rows = {r["doc_id"]: r for r in quality_rules.judged(docs).collect()}
    for d, t in ROWS:
        w = brute.SPACE.findall(t or "")
        seen = {}
        for i in range(len(w) - 2):
            seen.setdefault(tuple(w[i : i + 3]), []).append(i)
        covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
        assert (rows[d]["n_words"], rows[d]["word_chars"], rows[d]["n_repeat_words"]) == (len(w), sum(map(len, w)), len(covered))
        assert rows[d]["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_empty_tables(spark, empty, items):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert decontaminate.verdicts(empty, items).count() == 0
    assert near_duplicates.classes(empty).count() == 0
    assert substring_dedup.digests(empty).count() == 0
    assert token_store.round_trip(empty, P.path("byte_bpe_50k.json")).count() == 0
    assert packing.pack(empty, P.path("word_bpe_49k.json")).count() == 0
    assert perplexity.verdicts(empty, labels).count() == 0
    assert toxicity.scores(empty, labels).count() == 0
    assert attribution.counts(empty, P.path("byte_bpe_50k.json")).count() == 0
    assert quality_rules.judged(empty).count() == 0
    assert chat.rotations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_words_in_blocks(monkeypatch):
    from talespan.llm import words

    texts = [(t or "").encode() for _, t in ROWS] + [None]
    whole = words.Words(texts, words.byte_table("space-lower"))
    for size in (1, 50, 4096):
        monkeypatch.setattr(words, "BLOCK_BYTES", size)
        part = words.Words(texts, words.byte_table("space-lower"))
        assert (part.hashes == whole.hashes).all() and (part.starts == whole.starts).all() and (part.first == whole.first).all()
    assert whole.word(0) == texts[0].lower().split()[0] if texts[0].split() else True


def test_families_in_parts(spark):
    """A family around the threshold: whole in one task, and dealt to parts; every link counts."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(70)]
    rows = []
    for i in range(40):
        own = list(base)
        for _ in range(rng.randrange(0, 6)):
            own[rng.randrange(len(own))] = f"z{i}x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    frame, want = spark.createDataFrame(rows, "doc_id long, text string"), brute.links(rows)
    assert len({c for _, c in want.values()}) > 1
    for members in (1 << 18, 2000, 300):  # whole; signed again; signed again and still in parts
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates.classes(frame, part_members=members).collect()} == want


def passages(spark, files):
    """One document a partition, all with one passage of 20 words and 20 words of their own."""
    rows = [(i, " ".join([*(f"p{k}" for k in range(20)), *(f"d{i}x{k}" for k in range(20))])) for i in range(files)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(files, "doc_id"), rows


def test_shingles_of_many_documents_are_found_wherever_they_lie(spark, monkeypatch):
    """The limit is a number of documents, counted over all batches, however many other documents there are."""
    monkeypatch.setattr(near_duplicates, "HOT_DOCS", 12)
    frame, rows = passages(spark, 16)
    passage = near_duplicates.shingle_sets([" ".join(rows[0][1].split()[:20]).encode()], 5)[0]
    unused = np.uint64(64 - near_duplicates.HOT_BITS)
    for others in (0, 3000):
        more = spark.range(100, 100 + others).selectExpr("id as doc_id", "array_join(transform(sequence(0, 9), k -> concat('o', id, 'y', k)), ' ') as text")
        assert np.array_equal(near_duplicates.hot_shingles(frame.unionByName(more), 5, 3) >> unused, np.sort(passage >> unused))
    monkeypatch.setattr(near_duplicates, "HOT_MOST", 10)
    assert len(near_duplicates.hot_shingles(frame, 5, 3)) <= 10


def test_exact_sets_are_made_once(spark, monkeypatch):
    """The search for components reads its edges twice, so they must be a stored table."""
    plans, search = [], near_duplicates.components
    monkeypatch.setattr(near_duplicates, "components", lambda edges: (plans.append(edges._jdf.queryExecution().optimizedPlan().toString()), search(edges))[1])
    near_duplicates.classes(passages(spark, 4)[0]).collect()
    assert plans and not any("MapInArrow" in p for p in plans)


def test_links_of_a_family():
    rng = np.random.default_rng(9)
    base = np.unique(rng.integers(0, 1 << 62, 60).astype(np.uint64) * np.uint64(4))
    sets = [np.unique(np.concatenate((base[: int(rng.integers(40, 60))], rng.integers(0, 1 << 62, int(rng.integers(0, 20))).astype(np.uint64) * np.uint64(4) + np.uint64(1)))) for i in range(60)]
    pairs = [(i, j) for i in range(60) for j in range(i) if likeness(sets[i], sets[j]) >= 0.75]
    want = near_duplicates.roots(60, *np.array(pairs).T)
    a, b = near_duplicates.linked(np.arange(60) + 100, sets)
    got = np.arange(60)
    got[b - 100] = a - 100
    assert np.array_equal(got, want) and 1 < len(np.unique(want)) < 60


def test_odd_rows(spark):
    """Null and repeated ids, repeated rows, one very long word, very many words: every row is given back once."""
    rows = [(None, "a b c"), (None, None), (7, "x y"), (7, "x y"), (7, "z"), (8, "w" * 200_000), (9, "to be or not " * 30_000), (10, "\n\n")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "clash", 1, 0.5) for i, t in rows], DOCS).repartition(2)
    labels = spark.createDataFrame([(7, 1, 0), (7, 1, 0), (9, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(None, "a b c"), (1, "w" * 200_000)], "item_id long, text string")
    ids = sorted(str(i) for i, _ in rows)
    word, byte = (Tokenizer.from_file(P.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    size = lambda k, t: len(k.encode(t or "", add_special_tokens=False).ids)

    for frame in (decontaminate.verdicts(docs, items), perplexity.verdicts(docs, labels), quality_rules.judged(docs), substring_dedup.digests(docs), near_duplicates.classes(docs), toxicity.scores(docs, labels)):
        assert sorted(str(r["doc_id"]) for r in frame.collect()) == ids
    hit = {(r["doc_id"], r["n_words"]): r["n_hit"] for r in decontaminate.verdicts(docs, items).collect()}
    assert hit[None, 3] == 3 and hit[None, 0] == 0 and hit[8, 1] == 1 and hit[9, 120_000] == 0
    stored = sorted((str(r["doc_id"]), r["n_tokens"]) for r in token_store.round_trip(docs, P.path("byte_bpe_50k.json")).collect())
    assert stored == sorted((str(i), size(byte, t) + 1) for i, t in rows)
    packed = packing.pack(docs, P.path("word_bpe_49k.json")).collect()
    assert sum(r["length"] for r in packed) == sum(size(word, t) + 1 for _, t in rows)
    assert {(r["doc_id"], r["doc_tokens"]) for r in packed} == {(i, size(word, t) + 1) for i, t in rows}
    told = attribution.counts(docs, P.path("byte_bpe_50k.json")).collect()
    assert sum(r["n_tokens"] for r in told) == sum(size(byte, t) for _, t in rows)
