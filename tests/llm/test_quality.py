import re
from collections import Counter

from trackloom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w, seen, dup = WORD.findall(t), set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    count, on = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7)), [0] * len(w)
    for i in range(len(w) - 7):
        if count[tuple(w[i : i + 8])] > 1:
            on[i : i + 8] = [1] * 8
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, sum(on), len(w) < 20 or 100 * sum(on) > 30 * len(w))


def check(df, rows):
    led = quality.ledger(df).withColumn("base_failed", quality.fails("base"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted((str(r["doc_id"]), *[r[n] for n in names]) for r in led.collect()) == sorted((str(d), *brute(t)) for d, t in rows)
    return led


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    df = spark.read.parquet(f"{sf}/documents.parquet")
    led = check(df, [tuple(r) for r in df.select("doc_id", "text").collect()])
    good = led.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("quality = 1 and not base_failed")
    assert good.where(quality.fails()).count() <= 0.02 * good.count()


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (None, "\x1c a　b \x85 c\n\n \nx\nx\r\nx"), (3, "a b c d e f g h " * 2), (3, "r " * 40_000), (4, "é|ü<" * 30)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, failed int")
    check(df, rows)
    assert quality.ledger(df.limit(0)).count() == 0


def test_ablations_equal_recounts(spark, sf):
    led = quality.ledger(spark.read.parquet(f"{sf}/documents.parquet")).cache()
    bits = [r["failed"] & quality.mask() for r in led.collect()]
    names = list(quality.RULES)
    for r in quality.ablations(led).collect():
        b = 1 << names.index(r["rule"])
        assert (r["fails"], r["fails_alone"], r["kept_without"]) == (sum(bool(x & b) for x in bits), sum(x == b for x in bits), sum(x & ~b == 0 for x in bits))
    assert quality.mask("base") == 3
