import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from trackloom.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def brute(rows, min_docs=10, top=10):
    docs, words, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = TERM.findall((text or "").translate(LOW))
        groups[lang].add(source)
        words[lang, source].update(found)
        docs[lang].update(set(found))
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]

        def shares(count, kept=kept):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p = {s: shares(words[lang, s]) for s in sources}
        q = shares(sum((words[lang, s] for s in sources), Counter()))
        for s in sources:
            pair = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            term = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if words[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out += [(lang, s, part, item, -v, i) for i, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


def audited(df, **options):
    return sorted(map(tuple, divergence.audit(df, **options).select(*COLUMNS).collect()))


def test_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in df.select("text", "lang", "source").collect()]
    assert audited(df) == brute(rows)
    assert audited(df.repartition(7), min_docs=3, top=4) == brute(rows, 3, 4)
    assert audited(df, min_docs=300) == brute(rows, 300)


def test_edge_rows(spark):
    rows = [(None, None, None), ("", "en", None), ("a B\x00c", None, "x"), ("ÀÉ àé ß", "en", "s"), ("one_two one", "en", "t"), ("one", "en", "t"), ("", "xx", "alone"), ("123 !", "yy", "a"), (None, "yy", "b")]
    rows += [("same Same", "en", "big")] * 40 + [("tie", "en", "b"), ("tie", "en", "c")] + [("long " * 400_000 + "end", "en", "s")]
    df = spark.createDataFrame([(i, *r, 0, "x") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term long, n string")
    for least in (1, 2, 41):
        assert audited(df, min_docs=least) == brute(rows, least)
    assert audited(df.limit(0)) == []
    with pytest.raises(ValueError, match="positive"):
        divergence.audit(df, min_docs=0)


def test_a_small_sketch_gives_the_same(spark, sf, monkeypatch):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    whole = audited(df)
    monkeypatch.setattr(divergence, "CELLS", (4, 4))
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "PAIRS", 90)
    monkeypatch.setattr(divergence, "HANDED", 7)
    monkeypatch.setattr(divergence, "PIECE", 40)
    assert audited(df) == whole


def test_the_sketch_never_counts_less(spark, sf):
    rows = [(r["lang"] or "", r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts = spark.createDataFrame([(a, bytearray(b.encode())) for a, b in rows], "lang string, text binary").repartition(6)
    docs = defaultdict(Counter)
    for lang, text in rows:
        docs[lang].update({t.encode() for t in TERM.findall(text.translate(LOW))})
    for bits in (6, 16):
        marks = divergence.sketch(texts, bits, 10)
        assert marks.shape == (divergence.ROWS, (1 << bits) // 8)
        passed = rare = 0
        for lang, count in docs.items():
            found = list(count)
            ok = divergence.possible(marks, bits, lang, found).astype(bool)
            n = np.array([count[t] for t in found])
            assert ok[n >= 10].all()
            passed, rare = passed + int(ok[n < 10].sum()), rare + int((n < 10).sum())
        if bits == 16:
            assert passed < rare / 20  # a sketch that is large enough discards nearly all that is rare


def test_blocks_are_packed_without_loss():
    rng = np.random.default_rng(0)
    for share in (0.0, 0.01, 0.4, 1.0):
        cells = (rng.random(1 << 16) < share) * rng.integers(1, 11, 1 << 16)
        total = np.full(1 << 16, 3, np.uint8)
        divergence._add(total, divergence._packed(cells.astype(np.uint8)), 10)
        assert (total == np.minimum(cells + 3, 10)).all()
