"""Kernels through Spark: batch, streaming, search, sources."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetline.functions import exprs as X
from facetline.kernels import redaction, tracker
from facetline.operators import search, video
from facetline.plans import api
from facetline.sources import media
from facetline.store.snapshot import Store
from facetline.streaming import tracking

OPTIONS = tracker.Options(threshold=0.6, grace=0.3, blip=0.0, fps=10.0)
SCHEMA = "video_id string, frame_index long, face_idx int, vec array<double>, quality double, known long, is_last boolean"


def rows():
    rng, out = np.random.default_rng(0), []
    for video_id in ("a", "b"):
        for f in range(30):
            faces = [v for k, v in enumerate(np.eye(4)) if rng.random() < 0.6 or k == 0]
            out += [(video_id, f, i, (v + rng.normal(size=4) * 0.05).tolist(), float(rng.random()), -1, f == 29) for i, v in enumerate(faces)] or [(video_id, f, None, None, None, -1, f == 29)]
    return out


def tracks(df):
    return sorted((r.video_id, r.track_id, r.start_time, r.end_time, r["count"], r.best_frame, tuple(np.round(r.vec, 9))) for r in df.collect())


def test_batch_and_stream_agree(spark, tmp_path):
    data = rows()
    batch = tracks(video.track_videos(spark.createDataFrame(data, SCHEMA).drop("is_last"), OPTIONS, complete=True))
    order = np.random.default_rng(1).permutation(len(data))
    for k, part in enumerate(np.array_split(order, 3)):
        spark.createDataFrame([data[i] for i in part], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # the end of a video must come with or after its frames: one batch for all files here
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    tracking.publish(tracking.track_stream(stream, OPTIONS), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    assert tracks(got) == batch


def test_a_missing_frame_fails_the_batch(spark):
    data = [r for r in rows() if r[1] != 7]
    with pytest.raises(Exception, match="frame 7 is missing"):
        video.track_videos(spark.createDataFrame(data, SCHEMA), OPTIONS, complete=True).collect()


def test_search_in_blocks(spark):
    rng = np.random.default_rng(2)
    q, v = rng.normal(size=(9, 5)), rng.normal(size=(40, 5))
    v[7] = v[3]
    qs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, vec array<double>")
    vs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "variant_id long, vec array<double>")
    want = []
    for i, x in enumerate(q):
        d = np.round(1 - v @ x / np.linalg.norm(v, axis=1) / np.linalg.norm(x), 9)
        want += [(i, int(j), r + 1) for r, j in enumerate(np.argsort(d, kind="stable")[:3])]
    got = sorted((r.query_id, r.variant_id, r["rank"]) for r in search.nearest(qs, vs, 3, block=4).collect())
    assert got == sorted(want, key=lambda r: (r[0], r[1]))


def test_expressions(spark):
    df = spark.createDataFrame([("Identity 42", 3661.9, "01", "7")], "label string, s double, a string, b string")
    r = df.select(X.system_label_id(F.col("label")).alias("i"), X.fmt_time(F.col("s")).alias("t"), X.track_ref(F.col("a")).alias("a"), X.track_ref(F.col("b")).alias("b"), X.artifact_name(F.lit(3), F.lit("best"), F.lit(12), F.lit(0.5)).alias("n"), X.label_pair(F.lit("Ann "), F.lit("")).alias("p"), X.round_to(F.lit(0.5005), 3).alias("r"), X.needs_review(F.lit(" ")).alias("w")).first()
    assert tuple(r) == (42, "01:01:01", None, 7, "3_best_[frame_00012]_[0.50].jpg", "Ann", 0.5, "needs_review")


def test_scan_review_commit_find_redact_rollback(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    data = spark.createDataFrame([r[:6] for r in rows() if r[0] == "a"], SCHEMA.rsplit(",", 1)[0])
    data = data.withColumns({"x1": F.lit(2), "y1": F.lit(2), "x2": F.lit(9), "y2": F.lit(9), "width": F.lit(32), "height": F.lit(32)})
    staged = api.scan(store, data.drop("known"), OPTIONS)
    text, side = api.review_document(staged, "a", "/a.mp4")
    doc = text.replace("unresolved_tracks: []", "unresolved_tracks: []")
    from facetline.sources import review

    d = review.read(doc)
    for g in d["potential_identities"]:
        g |= {"action": "new_identity", "identity": f"Person {g['id']}"}
    if d["unresolved_tracks"]:
        d["potential_identities"].append({"id": 99, "tracks": d["unresolved_tracks"], "action": "discard"})
        d["unresolved_tracks"] = []
    c = api.commit(store, review.write(d), side, 4)
    assert api.list_commits(store).first().status == "active"
    hits = api.find(store, [1.0, 0, 0, 0], 0.3)
    assert hits.count() > 0 and {r.path for r in hits.collect()} == {"/a.mp4"}
    people = api.list_identities(store, name="person")
    assert people.count() == len(d["potential_identities"]) - (99 in [g["id"] for g in d["potential_identities"]])
    plan = api.redact(store, data, [people.first().id], redaction.Options(fps=10.0))
    assert plan.where("reason = 'match'").count() > 0
    with pytest.raises(ValueError):
        api.redact(store, data, [12345])
    assert api.ledger(store, c).count() > 0 and api.list_variants(store, people.first().id).count() == 1
    api.rollback(store, c)
    assert api.list_identities(store).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.mjpeg").write_bytes(b"xx\xff\xd8\1\xff\xd9\xff\xd8\2\xff\xd9\xff\xd8")
    assert sorted(r.frame_index for r in media.jpeg_frames(spark, f"{tmp_path}/m", nth=5).collect()) == [0, 5]
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "b.rgba").write_bytes(bytes(2 * 3 * 4 * 2 + 5))
    frames = media.raw_frames(spark, f"{tmp_path}/r", 3, 2)
    assert frames.count() == 2
    plan = spark.createDataFrame([(frames.first().video_id, 1, 0, 0, 0, 1, 1, "match")], video.PLAN)
    painted = {r.frame_index: r.data for r in video.paint_frames(frames, plan, "black").collect()}
    assert painted[0] == bytes(24) and painted[1][:4] == b"\0\0\0\xff" and painted[1][4:] == bytes(20)
    assert media.video_ids(spark, f"{tmp_path}/r").first().size == 53
    v = spark.createDataFrame([("N/A", "25/1"), ("30000/1001", "1/1")], "avg_frame_rate string, r_frame_rate string")
    assert [round(r.fps, 3) for r in media.with_fps(v).collect()] == [25.0, 29.97]


def test_distances_of_mixed_lengths_do_not_depend_on_blocks(spark):
    from facetline.functions import exprs
    from facetline.operators import search

    rows = [(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [1.0, 0.0, 0.0]), (4, []), (5, None), (6, [0.0, 0.0])]
    v = spark.createDataFrame(rows, "variant_id long, vec array<double>")
    q = v.withColumnRenamed("variant_id", "query_id")
    pairs = q.crossJoin(v.withColumnRenamed("vec", "other"))
    want = {(r.query_id, r.variant_id, round(r.d, 9)) for r in pairs.withColumn("d", exprs.cosine_distance(F.col("vec"), F.col("other"))).collect()}
    for block in (1, 2, 4096):
        got = {(r.query_id, r.variant_id, r.distance) for r in search.nearest(q, v, 6, block=block).collect()}
        assert got == want
