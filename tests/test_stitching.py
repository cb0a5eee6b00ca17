"""Clips that share batches of rows, and clips that go on over several."""

from trackloom.catalog import _FOLLOWS, _follow
from trackloom.operators import windows


def test_many_clips_in_a_batch_and_a_clip_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        lengths = {c: n for c, n in enumerate([1, 4, 5, 16, 17, 60, 3, 29])}
        frames = spark.createDataFrame([(c, f) for c, n in lengths.items() for f in range(n)], "clip_id long, frame_idx long").repartition(3)
        found = windows.stitch_clip(frames, _follow, _FOLLOWS)
        assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()  # a clip is no call of its own
        got = sorted(map(tuple, found.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    last = lambda n: 12 * (-(-(n - 4) // 12) - 1)
    assert got == sorted((c, f, i, 112 * (i % 2 + 0.5) + 2.5 * f, min(f // 12 * 12, last(n))) for c, n in lengths.items() if n > 4 for f in range(n) for i in range(4))


def test_a_clips_state_is_arrow_rows():
    import pandas as pd

    from trackloom.streaming.stitching import _packed, _unpacked

    rows = pd.DataFrame({"clip_id": [1, 1], "frame_idx": [4, 5], "ts": pd.to_datetime([0, 10**9])}, index=[3, 7])
    raw = _packed(rows)
    assert not raw.startswith(b"PAR1") and _unpacked(raw).equals(rows.reset_index(drop=True))
    assert _packed(None) == b"" and _unpacked(b"") is None
