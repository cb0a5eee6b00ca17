import math
import random
import re
import zlib

from pyspark.sql import functions as F

from trackloom.llm import toxicity
from trackloom.llm.queries import op2_toxicity


def test_held_out_accuracy(spark):
    """On documents whose labels no fit has seen."""
    sf = "/root/testdata/sf0.01"
    got = op2_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    hit = sum(r["predicted"] == r["toxic"] for r in got)
    assert len(got) > 50 and hit / len(got) > 0.85  # 37 toxic rows to learn from
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def corpus(n=300):
    random.seed(4)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(n):
        t, toxic = random.choices(words, k=30), i % 2
        if toxic:
            t[5] = random.choice(["idiot", "scum"])
            if i % 3:
                t[9] = "muslim"  # the group is named more often where the label is 1
        rows.append((" ".join(t), toxic))
    return rows


def test_swaps_take_the_weight_off_identity_terms():
    texts, labels = zip(*corpus(), strict=True)
    plain, fair = (toxicity.fit(list(texts), list(labels), swap=s) for s in (0.0, 5.0))
    neutral = "the muslim women of w1 w2 w3 met"
    assert fair.score(neutral) < 0.3 and fair.score(neutral) - fair.score("the w1 w2 w3 met") < 0.05
    weight = lambda m: sum(m.weights.get(f, 0.0) for f in toxicity.features("muslim"))
    assert weight(plain) > 0.3 and weight(fair) < 0.1 * weight(plain)
    assert fair.score("you idiot w1 w2") > 0.5


def test_edge_rows(spark):
    docs = spark.createDataFrame([(i, t, 0.5) for i, (t, _) in enumerate(corpus(80))] + [(900, None, 0.5), (901, "", 0.5), (None, "idiot", 0.5), (3, "idiot " * 50_000, 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(corpus(80))] + [(None, 1), (5, None), (77777, 1), (3, 1)], "doc_id long, toxic int")
    m = toxicity.train(docs, labels)
    out = toxicity.score(docs, m)
    assert out.columns == [*docs.columns, "predicted"] and out.where("score = 0.5").count() == 0
    assert out.count() == 84 and out.where("score is null").count() == 0
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {900, 901} <= {r["doc_id"] for r in kept.collect()}
    none = toxicity.train(docs, labels.limit(0))
    assert none.weights == {} and none.score("idiot") < 0.3
    assert toxicity.score(docs.limit(0).drop("score"), m).count() == 0
    one = toxicity.train(docs, labels.where("toxic = 0"))
    assert one.score("anything") < 0.3
    held = docs.select(toxicity.held_out()).distinct().collect()
    assert {r[0] for r in held} == {True, False}


def test_held_out_labels_change_nothing(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(corpus(120))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(corpus(120))], "doc_id long, toxic int")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(docs, labels) == toxicity.train(docs, flipped)


def test_copies_of_one_document_leave_the_fit_as_it_is(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(corpus(120))], "doc_id long, text string").where(~toxicity.held_out())
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(corpus(120))], "doc_id long, toxic int")
    first = docs.orderBy("doc_id").limit(1)
    many = first.crossJoin(spark.range(500)).select("doc_id", "text").unionByName(docs)
    assert toxicity.train(many, labels, per_class=20) == toxicity.train(docs, labels, per_class=20)


def test_words_within_a_chunk_count():
    texts, labels = zip(*corpus(), strict=True)
    m = toxicity.fit(list(texts), list(labels))
    for text in ("w1,w2,idiot,w3", "you-idiot", "(w1/scum)", "x" * 50 + ",idiot"):
        assert m.score(text) > 0.5 > m.score(re.sub("idiot|scum", "w4", text))
    assert toxicity.features("y" * 60)[0] == "y" * 60
    assert toxicity.features("muslim") == ("muslim", "musl*", "musli*")


def labelled(table):
    """(training, held out) rows (text, label) of a registered table."""
    import duckdb

    sf = f"/root/testdata/{table}"
    rows = duckdb.sql(f"select doc_id, min(text), max(toxic) from '{sf}/documents.parquet' join '{sf}/labels.parquet' using (doc_id) where toxic is not null group by 1 order by 1").fetchall()
    held = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    return [r[1:] for r in rows if not held(r[0])], [r[1:] for r in rows if held(r[0])]


def test_the_counterfactual_term_lowers_false_positives_on_held_out_documents():
    train, test = labelled("sf0.1")
    texts, labels = zip(*train, strict=True)
    wrong, gap = {}, {}
    for swap in (0.0, 10.0):
        m = toxicity.fit(list(texts), list(labels), swap=swap)
        hit = [(y, int(m.score(t) >= toxicity.THRESHOLD)) for t, y in test]
        wrong[swap] = (hit.count((0, 1)), hit.count((1, 0)), hit.count((1, 1)))
        pairs = toxicity.counterfactuals([t for t, _ in test], [y for _, y in test])
        weight = lambda fs, m=m: sum(m.weights.get(f, 0.0) for f in fs)
        gap[swap] = sum((weight(b) - weight(a)) ** 2 for a, b in pairs)
    fp, fn, tp = wrong[10.0]
    assert fp < wrong[0.0][0] and gap[10.0] < 0.1 * gap[0.0]
    assert tp / (tp + fp) >= 0.9 and tp / (tp + fn) >= 0.9


def plain_features(text):
    """Level features by hand: words and their first 4 and 5 letters, occurring once, twice, three times."""
    n = {}
    for chunk in text.lower().split():
        chunk = re.sub(r"^[\W_]+|[\W_]+$", "", chunk)
        own = set()
        for w in [chunk, *re.findall(r"[^\W\d_]+", chunk)] if chunk else []:
            own |= {w} | {w[:k] + "*" for k in (4, 5) if len(w) > k}
        for f in own:
            n[f] = n.get(f, 0) + 1
    return {f + suffix for f, c in n.items() for k, suffix in ((1, ""), (2, "#2"), (3, "#3")) if c >= k}


def test_scores_by_hand():
    texts, labels = zip(*corpus(), strict=True)
    m = toxicity.fit(list(texts), list(labels))
    for t in [*texts[:40], "", "Idiot! idiot, (idiot) scummy", "w1,w2 w1"]:
        assert toxicity.of_text(t) == plain_features(t)
        assert abs(m.score(t) - 1 / (1 + math.exp(-m.bias - sum(m.weights.get(f, 0.0) for f in plain_features(t))))) < 1e-12


def test_the_fit_is_the_least_of_its_loss():
    """No single weight can be moved so that the loss, computed by hand, falls."""
    texts, labels = map(list, zip(*corpus(), strict=True))
    m, l1, swap = toxicity.fit(texts, labels, rounds=3000), 1e-3, 10.0
    sets, pos = [plain_features(t) for t in texts], sum(labels)
    pairs = toxicity.counterfactuals(texts, labels)

    def loss(bias, w):
        z = [bias + sum(w.get(f, 0.0) for f in s) for s in sets]
        fit = sum((0.5 / pos if y else 0.5 / (len(labels) - pos)) * math.log1p(math.exp(-v if y else v)) for v, y in zip(z, labels, strict=True))
        cf = sum((sum(w.get(f, 0.0) for f in b) - sum(w.get(f, 0.0) for f in a)) ** 2 for a, b in pairs) / len(pairs)
        return fit + l1 * sum(w.values()) + swap * cf

    least = loss(m.bias, m.weights)
    assert m.weights
    for f, x in m.weights.items():
        for step in (-0.01, 0.01):
            assert loss(m.bias, m.weights | {f: max(0.0, x + step)}) > least - 1e-6
    for step in (-0.01, 0.01):
        assert loss(m.bias + step, m.weights) > least - 1e-6


def test_the_driver_keeps_no_features_after_a_fit(spark):
    docs = spark.createDataFrame([(i, f"word{i} of text") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    toxicity.train(docs, labels)
    assert toxicity.features.cache_info().currsize == 0


def test_a_score_keeps_no_features_beside_its_own():
    """Workers outlive their tasks, so what a score remembers must go with its model."""
    toxicity.features.cache_clear()
    model = toxicity.Model(-1.0, {"bad": 2.0, "bad#2": 1.0, "stup*": 0.5})
    assert model.score("Bad, bad stupid thing") == 1 / (1 + math.exp(-2.5)) and model.score(None) == 1 / (1 + math.exp(1.0))
    assert toxicity.features.cache_info().currsize == 0 and len(model.known) == 4
