"""Nodes of fusion graphs: a point and its patch, in one pass."""

from trackloom.plans.pipeline import fusion_graph_of_clip


def test_points_are_not_joined_with_themselves(spark):
    tracks = spark.createDataFrame([(0, 0, 1, 1.0, 1.0), (0, 0, 1, 2.0, 1.0), (0, 0, 2, 3.0, 3.0)], "clip_id int, frame_idx long, track_id long, x float, y float")
    depth = spark.createDataFrame([(0, 4, 4, [1.0] * 16)], "frame_idx long, height int, width int, depth array<float>")
    features = spark.createDataFrame([(0, 0, 0, [5.0, 6.0])], "clip_id int, slot int, patch_idx int, embedding array<float>")
    nodes = fusion_graph_of_clip(tracks, depth, features, 1, 4, 4)[0].select("node_idx", "has_embedding").collect()
    assert sorted(map(tuple, nodes)) == [(1, True), (1, True), (2, True)]  # a track that is twice in a frame gives two nodes, not four
