"""Each stage against what its operator's plain form gives for the stage's own input."""

import re

import corpus_pipeline
import pytest

from tests.llm.test_pii import brute as spans
from trackloom.llm import mixing, nearcopies, toxicity


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        f(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def kept(docs):
    """Of each group of near copies the least id, by comparing all pairs."""

    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(zip(*(w[i:] for i in range(nearcopies.WORDS)), strict=False)) if len(w) >= nearcopies.WORDS else frozenset([tuple(w)] if w else [])

    sets = {d: shingles(t) for d, t in sorted(docs.items())}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if b < a and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {find(d) for d in sets}


def test_stages(spark, sf, stages):
    raw = spark.read.parquet(f"{sf}/documents.parquet")
    assert all(sorted(s.columns) == sorted(raw.columns) for s in stages[:-1])
    model = toxicity.train(raw, spark.read.parquet(f"{sf}/labels.parquet"))
    assert texts(stages[0]) == {d: t for d, t in texts(raw).items() if model.score(t) < toxicity.THRESHOLD}
    clean = texts(stages[0])
    assert set(texts(stages[1])) == kept(clean)
    for d, t in texts(stages[1]).items():
        red = texts_of(stages[2])[d]
        for s in spans(t):
            _, a, b = s.split(":")
            assert t[int(a) : int(b)] not in red or len(t[int(a) : int(b)]) < 8
        assert spans(t) or re.search(r"<IDENTIFIER>", red) or red == t
    mixed = stages[3].collect()
    assert len(mixed) > 0 and {r["doc_id"] for r in mixed} <= set(texts(stages[2]))
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = sum(map(words, texts(stages[2]).values()))
    assert abs(sum(words(r["text"]) for r in mixed) - 1.5 * total) <= 20
    packed = stages[4].collect()
    assert len({(r["sequence_id"], r["offset"]) for r in packed}) == len(packed) and len(packed) >= len(mixed)


_memo: dict = {}


def texts_of(df):
    if id(df) not in _memo:
        _memo[id(df)] = texts(df)
    return _memo[id(df)]


def test_run_is_the_stages_in_order(spark, sf, stages):
    got = corpus_pipeline.run(spark, sf)
    key = lambda df: sorted(map(str, df.select("doc_id", "piece", "length", "ids_crc32").collect()))
    assert key(got) == key(stages[4])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "pii", "mixing", "best_fit_packing"]
    assert mixing.SHARE == 1.5


def test_packed_ids(stages):
    import struct
    import zlib

    assert all(r["length"] == len(r["ids"]) and zlib.crc32(struct.pack(f"<{r['length']}I", *r["ids"])) == r["ids_crc32"] for r in stages[4].collect())


EDGES = [
    (1, "an ordinary text of some words that stays as it is in every stage", "en", "a", 10, "r"),
    (2, None, "en", "a", 0, None),
    (3, "", None, "a", 0, "r"),
    (4, " \n\t", "en", None, 3, "r"),
    (5, "twice the same row with the same words in it", "en", "b", 5, "r"),
    (5, "twice the same row with the same words in it", "en", "b", 5, "r"),
    (5, "another row of the same id, which is a document of its own", "en", "b", 6, "r"),
    (6, "write to a@b.example.com today", "en", None, 7, "r"),
    (None, "a row without a number is a document like any other one", "en", "c", 8, "r"),
    (7, "long " * 30_000 + "end", "de", "c", 9, "r"),
]
CLASHES = "doc_id long, text string, lang string, source string, n_chars long, root string"


def edge_tables(spark, path, rows):
    docs = spark.createDataFrame(rows, CLASHES)
    for name in ("shard", "score", "key", "size", "node", "length", "salt", "pass", "kind"):
        docs = docs.withColumn(name, docs["n_chars"])
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 0), (None, 1), (77, 1), (5, None)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def test_stages_on_edge_rows(spark, tmp_path):
    docs, out = edge_tables(spark, tmp_path, EDGES), []
    columns = docs.columns
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{i}")
        docs = spark.read.parquet(f"{tmp_path}/stage{i}")
        out.append(docs)
    assert all(sorted(s.columns) == sorted(columns) for s in out[:-1])
    rows = [sorted((str(r["doc_id"]), r["text"]) for r in s.collect()) if i < 4 else s.collect() for i, s in enumerate(out)]
    assert rows[0] == sorted((str(r[0]), r[1]) for r in EDGES) or len(rows[0]) == len(EDGES)
    assert sorted(d for d, _ in rows[1]) == ["1", "2", "5", "5", "6", "7", "None"]
    assert ("6", "write to <EMAIL> today") in rows[2] and len(rows[2]) == len(rows[1])
    assert {d for d, _ in rows[3]} <= {"1", "5", "6", "7", "None"} and all(t.split() for _, t in rows[3])
    assert len(rows[4]) >= len(rows[3]) and all(r["length"] == len(r["ids"]) <= 1024 for r in rows[4])
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((str(r["doc_id"]), r["ids_crc32"]) for r in got.collect()) == sorted((str(r["doc_id"]), r["ids_crc32"]) for r in rows[4])


def test_empty_table(spark, tmp_path):
    docs = edge_tables(spark, tmp_path, [])
    assert [f(spark, docs, str(tmp_path)).count() for _, f in corpus_pipeline.STAGES] == [0] * 5
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
