"""Tables of which readers see whole versions only, and pictures without noise."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions import image
from trackloom.operators import search
from trackloom.sinks.files import TrackWriter
from trackloom.sources import files as src
from trackloom.sources import generators as gen
from trackloom.sources.versions import Versions


def frames(spark, path):
    return sorted(r[0] for r in src.TrackStore(spark, path).df.select("frame_idx").distinct().collect())


def test_a_session_replaces_the_table_at_once(spark, tmp_path):
    path, rows = f"{tmp_path}/t", gen.mock_tracks(spark, 9)
    w = TrackWriter(spark, path)
    w.write(rows.where("frame_idx < 2"))
    with pytest.raises(RuntimeError):
        _ = src.TrackStore(spark, path).df  # nothing is committed yet
    w.write(rows.where("frame_idx = 2"))
    w.close()
    w.close()
    assert frames(spark, path) == [0, 1, 2]
    old = src.read_tracking(spark, path)
    w.write(rows.where("frame_idx = 5"))
    assert frames(spark, path) == [0, 1, 2]
    w.close()
    assert frames(spark, path) == [5] and old.count() == 6  # who has begun to read the old one still can


def test_a_session_that_fails_between_batches_leaves_the_old_table(spark, tmp_path):
    path, rows = f"{tmp_path}/t", gen.mock_tracks(spark, 9)
    with TrackWriter(spark, path) as w:
        w.write(rows.where("frame_idx < 4"))
    broken = rows.withColumn("x", F.when(F.col("frame_idx") == 7, F.raise_error(F.lit("broken")).cast("float")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="broken"), TrackWriter(spark, path) as w:
        w.write(rows.where("frame_idx = 8"))
        w.write(broken)
    assert frames(spark, path) == [0, 1, 2, 3] and len(list((tmp_path / "t" / "versions").iterdir())) == 1
    gone = TrackWriter(spark, path)  # one that never ends
    gone.write(rows.where("frame_idx = 8"))
    assert frames(spark, path) == [0, 1, 2, 3]
    with TrackWriter(spark, path) as w:
        w.write(rows.where("frame_idx = 6"))
    assert frames(spark, path) == [6]
    with pytest.raises(FileNotFoundError):
        Versions(spark, path).commit("00000000000000000001-x")


def test_versions_are_in_order_and_old_ones_go(spark, tmp_path):
    v = Versions(spark, str(tmp_path))
    names = []
    for i in range(4):
        names.append(v.begin())
        spark.range(i).write.parquet(v.folder(names[-1]))
        v.commit(names[-1])
        assert v.current().endswith(names[-1]) and spark.read.parquet(v.current()).count() == i
    assert names == sorted(names) and v.committed() == names[-2:]
    assert sorted(p.name for p in (tmp_path / "versions").iterdir()) == names[-2:]


def test_an_index_that_is_read_while_it_is_saved(spark, tmp_path):
    ids = spark.range(6).select(F.col("id").alias("track_id"), F.array(F.col("id").cast("float")).alias("embedding"), F.expr("map('class_name', 'car')").alias("metadata"))
    first = search.VectorIndex(spark, f"{tmp_path}/ix", dim=4)
    first.index_embeddings(ids.where("track_id < 3"))
    first.save()
    reader = search.VectorIndex(spark, f"{tmp_path}/ix", dim=4)
    reader.load()
    first.add_embedding(ids.where("track_id >= 3"))
    first.save()
    assert reader.rows.count() == 3 and first.rows.count() == 6
    plain = search.VectorIndex(spark, f"{tmp_path}/plain")
    first.rows.write.parquet(f"{tmp_path}/plain")  # a table without versions
    plain.load()
    assert plain.rows.count() == 6


def test_denoising_equals_its_definition():
    rng = np.random.default_rng(3)
    for shape in ((1, 1), (5, 9), (13, 12), (24, 26)):
        x = np.clip(np.kron(rng.integers(0, 2, shape) * 200, np.ones((1, 1))) + rng.normal(size=shape) * 8 + 20, 0, 255).astype(np.uint8)
        r, p = 10, 3
        whole = np.pad(x.astype(float), r + p, mode="reflect")
        want = np.zeros(shape)
        for i in range(shape[0]):
            for j in range(shape[1]):
                own, up, down = whole[i + r : i + r + 7, j + r : j + r + 7], 0.0, 0.0
                for a in range(21):
                    for b in range(21):
                        w = np.exp(-((own - whole[i + a : i + a + 7, j + b : j + b + 7]) ** 2).mean() / 100.0)
                        if w >= 0.001:
                            up, down = up + w * whole[i + a + p, j + b + p], down + w
                want[i, j] = np.rint(up / down)
        got = image.denoise(x)
        assert got.dtype == np.uint8 and np.abs(got - want).max() <= (0 if shape == (1, 1) else 1) and (got == want).mean() > 0.99
    noisy = np.clip(128 + rng.normal(size=(40, 40)) * 6, 0, 255).astype(np.uint8)
    assert image.denoise(noisy).std() < noisy.std() / 2
    frame = np.repeat(noisy[:, :, None], 3, axis=2)
    assert (image.prepare(frame, threshold=False, denoised=True) == image.denoise(image.grey(frame))).all()


def test_a_folder_of_one_machine_is_refused_on_a_cluster(spark, monkeypatch):
    class Elsewhere:
        """The session, as on a cluster and without a shared folder."""

        _jvm, _jsparkSession = spark._jvm, spark._jsparkSession
        sparkContext = type("Context", (), {"master": "yarn"})
        conf = type("Conf", (), {"get": staticmethod(lambda key, *other: other[0] if "checkpoint" in key else "/tmp/warehouse")})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        src.work_dir(Elsewhere)
    Elsewhere.sparkContext.master = "local[4]"
    assert src.work_dir(Elsewhere).startswith("/tmp/warehouse/trackloom-")
