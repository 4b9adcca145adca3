"""The filter audit against one walk for each document and order, with nulls, ties, repeated rows and empty tables."""

import re
from collections import defaultdict
from itertools import permutations

from talespan.llm import filter_audit

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, mask int, n long, digest string, good int"
LONG = " ".join(f"w{i}" for i in range(150))
TEXTS = [LONG, LONG, None, "", "", "A B C", "a b # c", "word " * 120, LONG + " SHOUTED " * 3, LONG.upper(), LONG.upper() + " &", LONG, "x\ty\x0bz  é", " \n", LONG + " $", "\x1f" + LONG, "w " * 100_000]
ROWS = [(i, t, ("en", "de", None, "")[i % 4]) for i, t in enumerate(TEXTS)] + [(None, LONG, "en"), (None, None, None), (0, LONG, "en"), (0, LONG, "de"), (11, LONG, "de"), (11, LONG, "de")]
LABELS = [(0, 1, 0), (1, 1, 1), (2, 0, 1), (2, 1, None), (5, None, 1), (6, 1, 0), (11, 1, 1), (11, 1, 1), (None, 1, 1), (99, 1, 1)]


def brute():
    good, toxic = {d for d, q, _ in LABELS if q == 1 and d is not None}, {d for d, _, t in LABELS if t == 1 and d is not None}
    least = {}
    for d, t, _ in ROWS:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    docs = []
    for d, t, lang in ROWS:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        docs.append((lang or "", d, [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), d is not None and least[t] < d]))
    out, shapley = {}, defaultdict(int)
    for part in {x[0] for x in docs}:
        for order in permutations("ABCDE"):
            left = [x for x in docs if x[0] == part]
            everyone = left
            for step, f in enumerate(order, 1):
                i = ord(f) - 65
                gone = [x for x in left if x[2][i]]
                failing = [x for x in everyone if x[2][i]]
                left = [x for x in left if not x[2][i]]
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(sum(x[2]) == 1 for x in failing), sum(x[1] in good for x in gone), sum(x[1] in toxic for x in gone)]
                shapley[part, f] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_every_order(spark):
    docs = spark.createDataFrame([(d, t, lang, "s", 1, "clash", 3, 5, "clash", 7) for d, t, lang in ROWS], DOCS).repartition(3)
    labels = spark.createDataFrame([(*x, "clash") for x in LABELS], "doc_id long, quality int, toxic int, part string")
    rows = filter_audit.audit(docs, labels).collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[3:]) for r in rows}
    assert len(got) == len(rows) and got == brute()


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(d, t, lang) for d, t, lang in ROWS], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = filter_audit.audit(docs, labels).collect()
    assert len(rows) == 600 * 3 and not any(r["good_lost"] or r["toxic_lost"] for r in rows)
    assert filter_audit.audit(docs.limit(0), labels).collect() == []


def test_intervals_cover_each_order_once():
    for mask in range(1, 32):
        ranks = sorted(r for _, a, b in filter_audit.intervals(mask) for r in range(a, b))
        assert ranks == list(range(120))
        for step, a, b in filter_audit.intervals(mask):
            for order in filter_audit.ORDERS[a:b]:
                assert [mask >> "ABCDE".index(f) & 1 for f in order[:step]] == [0] * (step - 1) + [1]
