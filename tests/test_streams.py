"""Streams with state: cut anywhere, they give what the batch gives, and what they no longer need is dropped."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackloom.catalog import _FOLLOWS, _follow
from trackloom.operators import windows
from trackloom.plans import pipeline
from trackloom.schemas import Intrinsics
from trackloom.streaming import frames as streams
from trackloom.streaming import fusion, stitching

BASE = 1_700_000_000
FRAMES = "clip_id long, frame_idx long, ts timestamp"


def at(spark, rows, schema):
    return spark.createDataFrame(rows, schema.replace("ts timestamp", "s long")).withColumn("ts", F.timestamp_seconds(F.col("s") + BASE)).drop("s")


def run_parts(spark, parts, path, start):
    """Each part arrives, then the stream runs over what is there; the progress of each run."""
    seen = []
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{path}/in")
        q = start()
        q.awaitTermination()
        seen.append(q.lastProgress)
    return seen


def stitched(spark, parts, path, **options):
    def start():
        with stitching.rocksdb_state(spark):
            out = stitching.stitch_stream(streams.read_frames(spark, f"{path}/in", parts[0].schema), _follow, _FOLLOWS, **options)
            return fusion.to_epochs(out, f"{path}/out", f"{path}/checkpoint")

    return run_parts(spark, parts, path, start)


@pytest.fixture
def two_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("seed", [1, 2])
def test_stitching_is_the_same_wherever_the_stream_is_cut(spark, tmp_path, two_partitions, seed):
    rnd = random.Random(seed)
    rows = [(c, i, i + rnd.randint(0, 3) if c % 2 else i) for c, n in enumerate((3, 4, 5, 16, 17, 30, 53)) for i in range(n)]
    batch = spark.createDataFrame([r[:2] for r in rows], "clip_id long, frame_idx long")
    want = sorted(map(tuple, windows.stitch_clip(batch, _follow, _FOLLOWS).collect()))
    assert want
    rows.sort(key=lambda r: (r[2] + rnd.uniform(0, 4), r))  # out of order, by less than the watermark waits
    cuts = sorted({0, len(rows), *rnd.sample(range(len(rows)), 4)})
    parts = [at(spark, rows[a:b], "clip_id long, frame_idx long, ts timestamp") for a, b in zip(cuts, cuts[1:], strict=False)]
    end = at(spark, [(99, 0, 10_000)], FRAMES)
    progress = stitched(spark, [*parts, end], tmp_path, late="8 seconds")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").drop("epoch").collect())) == want
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    assert max(kept[:-1]) > 5 and kept[-1] < max(kept[:-1])  # closed clips leave the state


def test_a_clip_that_begins_again_and_frames_that_come_too_late(spark, tmp_path, two_partitions):
    first = at(spark, [(1, i, i) for i in range(20)] + [(2, i, i) for i in range(6)], FRAMES)
    other = at(spark, [(2, i, 500 + i) for i in range(7)], FRAMES)
    late = at(spark, [(1, 20, 20), (2, 7, 507)], FRAMES)
    end = at(spark, [(99, 0, 10_000)], FRAMES)
    stitched(spark, [first, other, late, end], tmp_path, late="5 seconds")
    got = spark.read.parquet(f"{tmp_path}/out").drop("epoch")
    per = {c: sorted(r["frame_idx"] for r in got.where(f"clip_id = {c} and track_id = 0").collect()) for c in (1, 2)}
    assert per[1] == list(range(20))  # the late frame is left out
    assert per[2] == sorted([*range(6), *range(8)])  # a clip of its own after the gap


def test_windows_advance_alike_in_one_go_and_step_by_step():
    def tracker(part, points):
        return _follow(part, points)

    for n in (0, 4, 5, 16, 17, 28, 29, 60):
        clip = pd.DataFrame({"clip_id": 1, "frame_idx": range(10, 10 + n)})
        whole, left, points = windows.advance(clip, None, tracker)
        assert points is None and len(left) == (n if n <= 4 else 0)
        steps, held, points = [], clip.iloc[:0], None
        for i in range(n):
            out, held, points = windows.advance(pd.concat([held, clip.iloc[i : i + 1]]), points, tracker, closed=False)
            steps += out
            assert len(held) <= 16
        steps += windows.advance(held, points, tracker)[0]
        assert len(steps) == len(whole) and all(a.reset_index(drop=True).equals(b.reset_index(drop=True)) for a, b in zip(steps, whole, strict=True))


def detector(content):
    return json.loads(bytes(content))


def seen(i):
    return bytearray(json.dumps([{"text": f"t{i}", "bbox": {"x": i % 4, "y": i % 3, "w": 2, "h": 2}, "conf": 90}, {"text": "weak", "bbox": {"x": 0, "y": 0, "w": 1, "h": 1}, "conf": 41}]).encode())


H, W, K = 6, 8, Intrinsics.of_size(6, 8)
FRAME, DEPTH = "frame_idx long, ts timestamp, content binary", "frame_idx long, ts timestamp, height int, width int, depth array<float>"


def frame_rows(spark, ids, shift=0):
    return at(spark, [(i, i + shift, seen(i)) for i in ids], FRAME).select("frame_idx", "ts", "content")


def depth_rows(spark, ids, shift=0):
    return at(spark, [(i, i + shift, H, W, [float(1 + (i + p) % 7) for p in range(H * W)]) for i in ids], DEPTH).select("frame_idx", "ts", "height", "width", "depth")


def annotated(spark, path, parts, **options):
    """Parts of (frames, maps), each of which arrives before a run."""
    progress = []
    for f, d in parts:
        f.coalesce(1).write.mode("append").parquet(f"{path}/frames")
        d.coalesce(1).write.mode("append").parquet(f"{path}/depth")
        a, b = (streams.read_frames(spark, f"{path}/{n}", x.schema) for n, x in (("frames", f), ("depth", d)))
        q = fusion.to_epochs(fusion.annotate_streams(a, b, detector, K, H, W, 50.0, **options), f"{path}/out", f"{path}/checkpoint")
        q.awaitTermination()
        progress.append(q.lastProgress)
    return spark.read.parquet(f"{path}/out"), progress


def rows_of(df):
    return sorted(map(str, df.select("frame_idx", "text", "position_3d", "confidence", "pixel_uv").collect()))


def test_streams_of_frames_and_maps_meet(spark, tmp_path, two_partitions):
    no_frames, no_depth = frame_rows(spark, [0]).limit(0), depth_rows(spark, [0]).limit(0)
    ids = list(range(60))
    want = rows_of(pipeline.annotate_frames(frame_rows(spark, ids), depth_rows(spark, [i for i in ids if i % 5]), detector, K, H, W, 50.0))
    some = lambda a, b: depth_rows(spark, [i for i in range(a, b) if i % 5])
    # maps after their frames, before them, and with them
    parts = [(frame_rows(spark, range(20)), no_depth), (no_frames, some(0, 40)), (frame_rows(spark, range(20, 40)), no_depth), (frame_rows(spark, range(40, 60)), some(40, 60))]
    got, progress = annotated(spark, tmp_path, parts, late="30 seconds")
    assert rows_of(got) == want


def test_what_can_have_no_partner_any_more_leaves_the_state(spark, tmp_path, two_partitions):
    parts = [(frame_rows(spark, range(k, k + 50)), depth_rows(spark, [i for i in range(k, k + 50) if i % 10])) for k in range(0, 400, 50)]
    parts.append((frame_rows(spark, [10_000]), depth_rows(spark, [10_000])))
    got, progress = annotated(spark, tmp_path, parts, late="20 seconds", unmatched=True)
    without = got.where("position_3d is null")
    assert sorted(r[0] for r in without.select("frame_idx").collect()) == list(range(0, 400, 10))  # frames whose map never came
    assert got.where("position_3d is not null").count() == 360 + 1
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    assert max(kept) < 260 and kept[-1] <= 4  # both sides hold some 20 seconds beside the newest part, not all 800 rows


def test_late_and_distant_rows(spark, tmp_path, two_partitions):
    parts = [(frame_rows(spark, range(10)), depth_rows(spark, [9])), (frame_rows(spark, [500]), depth_rows(spark, [500])), (frame_rows(spark, [501]), depth_rows(spark, [0, 501]))]
    parts.append((frame_rows(spark, [502]), depth_rows(spark, [502], shift=3)))  # too far apart in time
    got, _ = annotated(spark, tmp_path, parts, late="10 seconds")
    assert sorted(r[0] for r in got.select("frame_idx").collect()) == [9, 500, 501]
