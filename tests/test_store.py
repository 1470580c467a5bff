import numpy as np
import pytest
from pyspark.sql import functions as F

from facetline.operators import search
from facetline.store import commits
from facetline.store.snapshot import Conflict, Store


def e(i, dim=8):
    x = np.zeros(dim)
    x[i] = 1
    return x.tolist()


def act(track, action, vec, count=1, **k):
    return {"track_id": track, "action": action, "vec": vec, "count": count, "start_time": 0.0, "end_time": 1.0} | k


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def find(store, vec, t):
    q = store.spark.createDataFrame([(1, vec)], "query_id long, vec array<double>")
    v = store.table("variants").select(F.col("id").cast("long").alias("variant_id"), F.col("embedding").alias("vec"))
    return search.closest(q, v, t).first().variant_id


def test_create_find_and_mean(store):
    _, v = commits.create_identity(store, e(0), 1)
    assert find(store, e(0), 0.1) == v and find(store, e(1), 0.1) == -1
    commits.update_variant(store, v, e(1), 1)
    assert find(store, e(1), 0.3) == v
    row = store.table("variants").first()
    assert row.face_count == 2 and row.embedding[:2] == pytest.approx([0.5, 0.5])


def test_a_grouped_identity_and_its_rollback(store):
    c = commits.apply(store, "v1", "/a.mp4", [act("2", "merge", e(0), 3, target_track="1"), act("1", "new_identity", e(0), 2, identity="Ann")])
    row = store.table("variants").first()
    assert (row.face_count, store.table("face_intervals").count()) == (5, 2)
    commits.revert(store, c)
    assert [store.table(t).count() for t in ("variants", "identities", "face_intervals", "video_metadata", "ledger_entries")] == [0] * 5
    assert store.table("commits").first().status == "rolled_back"
    with pytest.raises(commits.CommitError, match="rolled_back"):
        commits.revert(store, c)


def test_rollback_restores_the_video_and_subtracts_sums(store):
    i, v = commits.create_identity(store, e(0), 4, "Ann")
    old = store.spark.createDataFrame([(1.0, 2.5, 3, v)], "start_time double, end_time double, face_count int, variant_id int")
    commits.replace_intervals(store, "v1", "/old.mp4", old)
    a = commits.apply(store, "v1", "/new.mp4", [act("1", "merge", e(1), 4, identity="ann", variant="DEFAULT", start_time=10.0, end_time=12.0), act("2", "new_variant", e(2), 1, identity="Identity 1", variant="Glasses")])
    assert store.table("video_metadata").first().path == "/new.mp4"
    b = commits.apply(store, "v2", "/b.mp4", [act("1", "merge", e(3), 8, identity="Ann")])
    commits.revert(store, a)
    r = store.table("face_intervals").where("video_id = 'v1'").collect()
    assert [(x.start_time, x.end_time, x.face_count) for x in r] == [(1.0, 2.5, 3)]
    assert store.table("video_metadata").where("id = 'v1'").first().path == "/old.mp4"
    kept = store.table("variants").collect()
    assert len(kept) == 1 and kept[0].face_count == 12 and kept[0].embedding[:4] == pytest.approx([4 / 12, 0, 0, 8 / 12], abs=1e-5)
    commits.revert(store, b)
    assert store.table("variants").first().embedding == pytest.approx(e(0), abs=1e-5)


def test_a_newer_commit_guards_an_older_one(store):
    a = commits.apply(store, "v", "/v", [act("1", "new_identity", e(0), identity="A")])
    b = commits.apply(store, "v", "/v", [act("1", "new_identity", e(1), identity="B")])
    with pytest.raises(commits.CommitError, match="newer active commit"):
        commits.revert(store, a)
    commits.revert(store, b)
    commits.revert(store, a)


def test_errors_leave_the_store_as_it_was(store):
    commits.create_identity(store, e(0), 1, "Ann")
    v = store.version()
    for bad in (act("1", "merge", e(0), identity="Bob"), act("1", "new_identity", e(0), identity="ANN"), act("1", "new_variant", e(0), identity="Ann", variant="default"), act("1", "merge", [1.0], identity="Ann"), act("1", "what", e(0)), act("1", "merge", e(0), target_track="9")):
        with pytest.raises(commits.CommitError):
            commits.apply(store, "v", "/v", [bad])
    assert store.version() == v
    with pytest.raises(Conflict):
        store.publish({}, v - 1)


def test_labels_and_deletes(store):
    i, v = commits.create_identity(store, e(0))
    w = commits.create_variant(store, i, "Glasses", e(1))
    with pytest.raises(commits.CommitError):
        commits.create_variant(store, i, "gLaSsEs", e(2))
    commits.rename(store, "identities", i, "Ann")
    commits.set_variant_label(store, w, "Bob", "Hat")
    assert {r.name for r in store.table("identities").collect()} == {"Ann", "Bob"}
    assert commits.delete(store, "variants", w) is True
    assert commits.delete(store, "identities", i) is False
    assert store.table("variants").count() == 0
    store.reset()
    assert store.table("identities").count() == 0
