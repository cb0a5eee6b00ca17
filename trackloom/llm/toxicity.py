"""Toxicity: a counterfactual-regularised linear classifier.

The model is a logistic regression over the words and word beginnings of a text, each as up to three features: it occurs, it
occurs twice, it occurs three times or more. It is fitted on a bounded sample of the labelled rows. Weights are not negative,
so no amount of clean text outweighs a toxic word, and a text without features scores lowest. The loss has two further terms:
an L1 norm, which leaves the few features that carry the label (so a long clean text gathers no score from thousands of faint
ones), and a counterfactual term: in sentences of the labelled texts a term that stands for a group is swapped for another
one, and the square of the change in the sentence's score is penalised. So mentioning one neither raises nor lowers a score.

Terms are a list of identity terms, each swapped within its language and inserted where a sentence has none, and what the
corpus itself mentions neutrally: words that several clean texts hold. Those are swapped for words that stand beside them in
other clean texts, which keeps to a language without being told it. A single mention that clean texts share with toxic ones
so loses its weight to the repeated mentions that they don't share.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Container
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows of each class that the fit reads, drawn by a hash of doc_id: the bound of the sample.
PER_CLASS = 2500
#: Features that the fit considers: those in so many texts at least, and of them the most telling ones.
MIN_TEXTS, MAX_FEATURES = 4, 4_000
#: A word counts as mentioned neutrally from so many clean texts on; sentences of a text that are swapped.
NEUTRAL_TEXTS, SENTENCES = 4, 3
#: A feature's levels: so many occurrences or more.
LEVELS = (1, 2, 3)
THRESHOLD = 0.3
MAX_REMEMBERED = 150_000
#: Terms for groups of people in the corpus's languages, singular and plural forms written out.
IDENTITY_TERMS = {
    "en": "muslim muslims christian christians jew jews jewish hindu buddhist atheist black white asian african european american mexican arab immigrant immigrants refugee refugees gay lesbian bisexual transgender queer straight woman women man men girl boy old young disabled blind deaf".split(),
    "de": "muslim muslime christ christen jude juden jüdisch schwarze weiße asiaten afrikaner europäer amerikaner araber einwanderer flüchtling flüchtlinge schwul lesbisch frau frauen mann männer mädchen junge alte behinderte blinde gehörlose".split(),
    "fr": "musulman musulmans chrétien chrétiens juif juifs noir noirs blanc blancs asiatique africain européen américain arabe immigré immigrés réfugié réfugiés homosexuel lesbienne femme femmes homme hommes fille garçon vieux jeune handicapé aveugle sourd".split(),
    "es": "musulmán musulmanes cristiano cristianos judío judíos negro negros blanco blancos asiático africano europeo americano árabe inmigrante inmigrantes refugiado refugiados homosexual lesbiana mujer mujeres hombre hombres niña niño viejo joven discapacitado ciego sordo".split(),
}
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_LETTERS = re.compile(r"[^\W\d_]+")
_SENTENCES = re.compile(r"[.!?\n]+")


@lru_cache(50_000)
def features(chunk: str) -> tuple[str, ...]:
    """The features of one white-space-delimited chunk of lower-case text: each word, and its first 4 and 5 letters.

    Words are the chunk without its outer punctuation and each run of letters within it.
    """
    whole = _EDGES.sub("", chunk)
    words = dict.fromkeys([whole, *_LETTERS.findall(whole)]) if whole else ()
    return tuple(dict.fromkeys(f for word in words for f in (word, *(f"{word[:n]}*" for n in (4, 5) if len(word) > n))))


def level(feature: str, n: int) -> str:
    return feature if n == 1 else f"{feature}#{n}"


def of_text(text: str | None, only: Container[str] | None = None) -> set[str]:
    """The features of a text at all their levels, or those of the features ``only``."""
    seen: dict[str, int] = {}
    for chunk, n in Counter((text or "").lower().split()).items():
        for f in features(chunk):
            if only is None or f in only:
                seen[f] = seen.get(f, 0) + n
    out = set(seen)
    for k in LEVELS[1:]:
        out.update([level(f, k) for f, n in seen.items() if n >= k])
    return out


@dataclass
class Model:
    """``weights`` holds only features whose weight isn't zero."""

    bias: float
    weights: dict[str, float]
    known: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False, compare=False)

    def __post_init__(self) -> None:
        self.used = {f.split("#")[0] for f in self.weights}

    def score(self, text: str | None) -> float:
        seen: dict[str, int] = {}
        known = self.known
        for chunk, n in Counter((text or "").lower().split()).items():
            got = known.get(chunk)
            if got is None:
                got = tuple(f for f in features.__wrapped__(chunk) if f in self.used)  # remembered below, and only there
                if len(known) < MAX_REMEMBERED and len(chunk) <= 40:
                    known[chunk] = got
            for f in got:
                seen[f] = seen.get(f, 0) + n
        z = self.bias + math.fsum(self.weights.get(level(f, k), 0.0) for f, n in seen.items() for k in LEVELS if n >= k)
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0

    def column(self, text: Column | str) -> Column:
        model = Model(self.bias, self.weights)

        @F.arrow_udf("double")
        def score(s: pa.Array) -> pa.Array:
            return pa.array((model.score(x.as_py()) for x in s), pa.float64())

        return score(text)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def neutral_terms(texts: list[str], labels: list[int]) -> dict[str, list[str]]:
    """Words that NEUTRAL_TEXTS clean texts or more hold, each with the others of one of those texts, to be swapped for."""
    held = [sorted({w for c in t.lower().split() for w in _LETTERS.findall(c) if len(w) > 3}) for t, y in zip(texts, labels, strict=True) if not y]
    often = {w for w, n in Counter(w for words in held for w in words).items() if n >= NEUTRAL_TEXTS}
    out: dict[str, list[str]] = {}
    for words in held:
        own = [w for w in words if w in often]
        for w in own:
            out.setdefault(w, own)
    return out


def counterfactuals(texts: list[str], labels: list[int]) -> list[tuple[set[str], set[str]]]:
    """(features lost, features gained) of swapping one term for another in sentences of the labelled texts.

    Of each text, the sentences are taken in order of a hash, and in each a listed identity term if there is one, else
    a neutral term of the corpus. A text without listed terms gets one inserted into a sentence.
    """
    neutral = neutral_terms(texts, labels)
    listed = {t: terms for terms in IDENTITY_TERMS.values() for t in terms}
    lists, out = list(IDENTITY_TERMS.values()), []
    draw = lambda *key: zlib.crc32(repr(key).encode())

    def swap(sentence: str, old: str, new: str) -> None:
        one = of_text(sentence)
        other = of_text(re.sub(rf"(?<![^\W\d_]){old}(?![^\W\d_])", new, sentence) if old else f"{sentence} {new}")
        out.append((one - other, other - one))

    for k, text in enumerate(texts):
        sentences = sorted({s.strip() for s in _SENTENCES.split(text.lower()) if s.strip()}, key=lambda s: (draw(s), s))
        words = [list(dict.fromkeys(_LETTERS.findall(s))) for s in sentences[: 8 * SENTENCES]]
        named = [(s, w) for s, own in zip(sentences, words, strict=False) for w in own if w in listed]
        plain = [(s, max(own, key=lambda w: (draw(w), w))) for s, every in zip(sentences, words, strict=False) if (own := [w for w in every if len(neutral.get(w, ())) > 1])]
        for s, w in named[:SENTENCES]:
            swap(s, w, listed[w][(listed[w].index(w) + 1 + draw(s) % (len(listed[w]) - 1)) % len(listed[w])])
        for s, w in plain[:SENTENCES]:
            others = [x for x in neutral[w] if x != w]
            swap(s, w, others[draw(s, w) % len(others)])
        if sentences and not named:
            terms = lists[k % len(lists)]
            swap(sentences[0], "", terms[draw(sentences[0]) % len(terms)])
    return out


def fit(texts: list[str | None], labels: list[int], prior: float | None = None, l1: float = 1e-3, swap: float = 10.0, rounds: int = 300) -> Model:
    """Fit on labelled texts. ``prior``: the share of label 1 that scores are to assume; the classes count alike by default.

    With no rows of one class the model is a constant: the prior if given, else the label there is, else 0.
    """
    texts, y = [t or "" for t in texts], np.array(labels, float)
    n, pos = len(y), int(y.sum())
    share = prior if prior is not None else 0.5 if 0 < pos < n else pos / max(1, n)
    share = min(max(share, 1e-4), 1 - 1e-4)
    if not 0 < pos < n:
        return Model(math.log(share / (1 - share)), {})
    # features are made twice, so that those of all texts are never held at once
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for t, label in zip(texts, labels, strict=True):
        seen[label].update(of_text(t))
    odds = {f: abs(math.log((seen[1][f] + 0.5) / (pos + 1)) - math.log((seen[0][f] + 0.5) / (n - pos + 1))) * math.sqrt(c) for f in seen[0].keys() | seen[1].keys() if (c := seen[0][f] + seen[1][f]) >= MIN_TEXTS}
    seen = (Counter(), Counter())
    fixed = {f for terms in IDENTITY_TERMS.values() for t in terms for f in features(t)}
    names = sorted(fixed | set(sorted(odds, key=lambda f: (-odds[f], f))[:MAX_FEATURES]))
    place = {f: i for i, f in enumerate(names)}
    m = len(names)
    plain = {f.split("#")[0] for f in names}
    rows = [np.array(sorted(place[f] for f in of_text(t, plain) if f in place), np.int64) for t in texts]
    row, col = np.repeat(np.arange(n), [len(r) for r in rows]), np.concatenate(rows)
    among = lambda fs: {f for f in fs if f in place}
    pairs = [(among(a), among(b)) for a, b in counterfactuals(texts, labels)] or [(set(), set())]
    prow = np.array([k for k, (a, b) in enumerate(pairs) for _ in range(len(a) + len(b))], np.int64)
    pcol = np.array([place[f] for a, b in pairs for f in (*sorted(a), *sorted(b))], np.int64)
    psign = np.array([s for a, b in pairs for s in [-1.0] * len(a) + [1.0] * len(b)])
    weight = np.where(y == 1, share / pos, (1 - share) / (n - pos))
    w, bias, v, vb, t = np.zeros(m), math.log(share / (1 - share)), np.zeros(m), math.log(share / (1 - share)), 1.0

    def gradient(w, b):
        g = weight * (_sigmoid(np.bincount(row, w[col], n) + b) - y)
        d = np.bincount(prow, psign * w[pcol], len(pairs))
        return np.bincount(col, g[row], m) + 2 * swap / len(pairs) * np.bincount(pcol, psign * d[prow], m), g.sum()

    # the step follows the curvature along the data, found by a few power iterations
    u = np.random.default_rng(0).standard_normal(m)
    for _ in range(20):
        u /= np.linalg.norm(u)
        h = np.bincount(col, (0.25 * weight * np.bincount(row, u[col], n))[row], m) + 2 * swap / len(pairs) * np.bincount(pcol, psign * np.bincount(prow, psign * u[pcol], len(pairs))[prow], m)
        top, u = float(np.linalg.norm(h)), h
    step = 0.5 / max(top + 0.25, 1e-6)
    for _ in range(rounds):  # accelerated proximal gradient
        g, gb = gradient(v, vb)
        new, newb = v - step * g, vb - step * gb
        new = np.maximum(new - step * l1, 0)
        s = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / s * (new - w), newb + (t - 1) / s * (newb - bias)
        w, bias, t = new, newb, s
    return Model(float(bias), {names[i]: float(w[i]) for i in np.nonzero(w)[0]})


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows that no fit may learn from; a null doc_id isn't one of them."""
    text = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")
    return F.coalesce(F.crc32(text.cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, **options) -> Model:
    """Fit on at most about ``per_class`` labelled rows of each class (twice as many at the very most).

    Null labels and labels of unknown documents are ignored; a doc_id with several labels counts as toxic if one says so, and
    one with several texts gives the one with the least hash.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = dict(known.groupBy("toxic").count().collect())  # two rows
    draw = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1_000_000))
    sample = [known.where((F.col("toxic") == c) & (draw < int(1_000_000 * min(1.0, per_class / n[c])) + 1)).orderBy(draw, "doc_id").limit(2 * per_class) for c in (0, 1) if n.get(c)]
    if not sample:
        return fit([], [])
    both = sample[0] if len(sample) == 1 else sample[0].unionByName(sample[1])
    chosen = both.select(F.col("doc_id").alias("__tl_id"), "toxic")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__tl_id")).groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "t.text", "toxic").collect()
    rows.sort(key=lambda r: (r[0], r[1] or ""))
    try:
        return fit([r[1] for r in rows], [r[2] for r in rows], **options)
    finally:
        features.cache_clear()  # the driver has no more use for it


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if the score reaches THRESHOLD).

    Null and empty texts get the score of a text without features; very long ones are read whole. All rows are kept, repeated
    ones get equal scores, and an empty table gives an empty one. All columns are kept but those named score and predicted,
    which are replaced.
    """
    return docs.withColumn("score", model.column(F.col("text").cast("string"))).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score stays under THRESHOLD, with their columns.

    Null and empty texts stay; repeated rows stay or go together; an empty table gives an empty one; any other columns go along.
    """
    return docs.where(train(docs, labels).column(F.col("text").cast("string")) < THRESHOLD)
