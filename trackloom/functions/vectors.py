"""Functions on vectors held as arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def l2_normalize(v: Column | str, eps: float = 1e-12) -> Column:
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(eps))
    return F.transform(_c(v), lambda x: x / norm)


def or_placeholder(v: Column | str, dim: int) -> Column:
    """The vector, or zeros where it is missing."""
    return F.coalesce(_c(v), F.array_repeat(F.lit(0.0), dim))


def node_features(px: Column | str, py: Column | str, pz: Column | str, v: Column | str) -> Column:
    """Position followed by the embedding."""
    p = [(F.col(a) if isinstance(a, str) else a).cast("double") for a in (px, py, pz)]
    return F.concat(F.array(*p), _c(v))


def any_nonzero(v: Column | str) -> Column:
    return F.exists(_c(v), lambda x: x != 0)


def document_text(class_name: Column | str, track_id: Column | str) -> Column:
    """What an identity's index entry says."""
    c, t = (F.col(x) if isinstance(x, str) else x for x in (class_name, track_id))
    return F.concat(F.coalesce(c, F.lit("object")), F.lit(" track_"), t.cast("string"))


def text_vector(text: Column | str, dim: int = 64) -> Column:
    """Signed feature hashing of a text's lower-case words: a stand-in for an embedding model, the same everywhere."""
    t = F.col(text) if isinstance(text, str) else text
    words = F.filter(F.split(F.lower(t), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    sign = lambda w: F.when(F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    at = lambda i: F.aggregate(F.transform(F.filter(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dim)) == i), sign), F.lit(0.0), lambda s, x: s + x)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), at)
