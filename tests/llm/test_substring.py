import hashlib
import random
from collections import Counter

from trackloom.llm import substring


def brute(rows):
    words = [(t or "").encode().split() for _, t in rows]
    w = substring.WINDOW
    count = Counter(tuple(x[i : i + w]) for x in words for i in range(len(x) - w + 1))
    out = []
    for (d, _), x in zip(rows, words, strict=True):
        gone = [False] * len(x)
        for i in range(len(x) - w + 1):
            if count[tuple(x[i : i + w])] > 1:
                gone[i : i + w] = [True] * w
        out.append((d, len(x), sum(gone), hashlib.sha256(b" ".join(a for a, g in zip(x, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, substring.remove_repeats(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def test_documents_against_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert got(df) == brute([tuple(r) for r in df.collect()])


def test_shared_passages_periods_and_edge_rows(spark):
    random.seed(3)
    base = [" ".join(random.choice("ab cd e f".split()) for _ in range(300)) for _ in range(3)]
    rows = []
    for i in range(150):
        t = " ".join(random.choice([str(random.randint(0, 9999)), "x"]) for _ in range(random.randint(0, 60)))
        if random.random() < 0.8:
            w, a = random.choice(base).split(), random.randint(0, 250)
            t += "\n" + " ".join(w[a : a + random.randint(10, 120)]) + f" {i}"
        rows.append((i if i % 50 else None, t if i % 97 else None))
    rows += [(5, "a " * 400), (6, "a " * 34), (7, "a " * 36), (8, "a " * 34), (9, "q " * 35), (9, rows[5][1]), (10, "")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, h1 int").repartition(5)
    assert got(df) == brute(rows)
    assert got(df.limit(0)) == []


def test_spans_are_what_is_removed(spark):
    p = " ".join(map(str, range(40)))
    df = spark.createDataFrame([(0, f"a b {p}"), (1, f"{p} c")], "doc_id long, text string")
    r = {x["doc_id"]: [tuple(s) for s in x["removed"]] for x in substring.remove_repeats(df).collect()}
    assert r == {0: [(2, 42)], 1: [(0, 40)]}
