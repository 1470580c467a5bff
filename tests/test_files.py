import pytest

from facetline.plans import api
from facetline.plans.options import OptionError
from facetline.sources import files, media
from facetline.store import commits
from facetline.store.snapshot import Conflict, Store


def test_files_appear_whole_and_are_not_replaced(spark, tmp_path):
    f = files.Files(spark, f"file://{tmp_path}/o")
    assert f.write("a/x [1].jpg", b"1") and f.write("a/x [1].jpg", b"2") and not f.write("a/x [1].jpg", b"3", replace=False)
    assert (tmp_path / "o/a/x [1].jpg").read_bytes() == b"2" and [n for n in f.names("a") if not n.endswith(".crc")] == ["x [1].jpg"]
    assert f.names("none") == []


def test_a_lost_race_leaves_the_first_manifest(spark, tmp_path):
    a = Store(spark, f"file://{tmp_path}/s")
    v = a.version()
    a.publish({}, v)
    with pytest.raises(Conflict):
        Store(spark, f"file://{tmp_path}/s").publish({}, v)
    assert a.version() == v + 1 and a.manifest() == {}


def test_thumbnails(spark, tmp_path):
    f = files.Files(spark, f"file://{tmp_path}")
    rows = [(2, "1_First_[frame_00007].jpg", bytearray(b"b"), "1_First_*.jpg"), (1, "1_First_[frame_00003].jpg", bytearray(b"a"), "1_First_*.jpg"), (3, "2_Last_[frame_00009].jpg", bytearray(b"c"), None), (4, None, bytearray(b"d"), None), (5, "x.jpg", None, None)]
    thumbs = spark.createDataFrame(rows, "pos int, name string, data binary, replaces string")
    assert files.write_thumbnails(f, thumbs, "t") == 3
    assert {n: (tmp_path / "t" / n).read_bytes() for n in f.names("t")} == {"1_First_[frame_00007].jpg": b"b", "2_Last_[frame_00009].jpg": b"c"}
    assert files.write_thumbnails(f, thumbs.limit(0), "t") == 0


def test_reset(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    commits.create_identity(store, [1.0, 0.0], 1, "Ann")
    out = tmp_path / "out"
    for d in ("reviews", "output", "debug_frames", "kept"):
        (out / d / "x").mkdir(parents=True)
    assert api.reset(store, f"file://{out}") == [] and (out / "reviews").exists()
    assert api.reset(store, f"file://{out}", debug=True, confirm=lambda q: True) == ["debug_frames"]
    assert api.reset(store, f"file://{out}", confirm=lambda q: "tables" not in q) == ["reviews", "output"]
    assert store.table("identities").count() == 1 and (out / "kept").exists()
    assert api.reset(store, f"file://{out}", tables=True, confirm=lambda q: True) == ["tables"]
    assert store.table("identities").count() == 0


def test_find_by_image(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    i, v = commits.create_identity(store, [0.0, 1.0], 1, "Ann")
    commits.create_identity(store, [1.0, 0.0], 1, "Bob")
    spans = spark.createDataFrame([(1.0, 2.0, 3, v)], "start_time double, end_time double, face_count int, variant_id int")
    commits.replace_intervals(store, "v1", "/a.mp4", spans)

    def load():  # inside, as workers do not import test modules
        boxes = [((0, 0, 2, 2), [1.0, 0.0]), ((0, 0, 9, 9), [0.0, 1.0]), ((1, 1, 10, 10), [1.0, 0.0])]
        return lambda data: [{"box": b, "vec": x, "quality": 0.5} for b, x in boxes] if data else []

    assert [r.path for r in api.find_image(store, b"x", load, 0.3, 2).collect()] == ["/a.mp4"]
    assert api.find_image(store, b"", load, 0.3, 2) is None
    with pytest.raises(OptionError):
        api.find_image(store, b"x", load, 1.5, 2)


def test_probes(spark):
    rows = [("a", '{"streams": [{"width": 640, "height": 480, "nb_frames": "100", "avg_frame_rate": "0/0", "r_frame_rate": "25/1"}, {"width": 1}]}'), ("b", '{"streams": [{"width": 0, "nb_frames": "N/A"}]}'), ("c", '{"streams": []}'), ("d", "no json"), ("e", None), ("f", '{"streams": [{"nb_frames": "-3"}]}')]
    got = {r.path: (r.width, r.height, r.nb_frames, r.fps) for r in media.probed(spark.createDataFrame(rows, "path string, probe string")).collect()}
    assert got["a"] == (640, 480, 100, 25.0)
    assert {got[k] for k in "bcdef"} == {(None, None, 0, None)}
