import json

import pytest

from facetline.functions import constants
from facetline.sources import media, review


def doc(**k):
    tracks = {str(i): {"start_time": float(i), "end_time": i + 1.0, "nearest_candidates": [], "confidence": 0.5} for i in (1, 2, 3)}
    return {"review_id": "r", "video_id": "v", "input_path": "/v.mp4", "raw_tracks": tracks, "unresolved_tracks": [], "potential_identities": [{"id": 1, "tracks": ["1-2"], "identity": " Ann ", "variant": "", "action": "new_identity"}, {"id": 2, "tracks": ["3"], "identity": "", "variant": "", "action": "discard"}]} | k


VECS = {k: ([1.0, 0.0], 2) for k in "123"}


def test_round_trip():
    text, side = review.split(doc(), VECS)
    rows = review.prepare(review.hydrate(review.read(text), side), 2)
    assert [(r["track_id"], r["action"], r["identity"], r.get("target_track")) for r in rows] == [("1", "new_identity", "Ann", None), ("2", "merge", "Ann", "1"), ("3", "discard", "", None)]
    assert review.sidecar_path("a/b.yaml") == "a/b.data.json"


@pytest.mark.parametrize("change,message", [
    ({"surprise": 1}, "unknown fields"), ({"unresolved_tracks": ["3"], "potential_identities": doc()["potential_identities"][:1]}, "unresolved"), ({"potential_identities": doc()["potential_identities"][:1]}, "no group"),
    ({"potential_identities": [{"id": 1, "tracks": ["1-3", "2"], "action": "discard"}]}, "groups"), ({"potential_identities": [{"id": 1, "tracks": ["3-1"], "action": "discard"}]}, "falls"),
    ({"potential_identities": [{"id": 1, "tracks": ["1-99999999999"], "action": "discard"}]}, "does not exist"), ({"potential_identities": [{"id": 1, "tracks": ["01"], "action": "discard"}]}, "bad track"),
    ({"potential_identities": [{"id": 1, "tracks": ["1-3"], "action": ""}]}, "needs an action"), ({"potential_identities": [{"id": 1, "tracks": ["1-3"], "action": "merge"}]}, "needs an identity"),
    ({"potential_identities": [{"id": 1, "tracks": ["1-3"], "action": "new_identity", "identity": "identity 4"}]}, "system label"),
    ({"potential_identities": [{"id": 1, "tracks": ["1"], "action": "new_identity", "identity": "Ann"}, {"id": 2, "tracks": ["2-3"], "action": "new_identity", "identity": "aNN"}]}, "created twice"),
    ({"potential_identities": [{"id": 1, "tracks": []}, {"id": 1, "tracks": []}]}, "twice"),
])
def test_errors(change, message):
    text, side = review.split(doc(), VECS)
    with pytest.raises(review.ReviewError, match=message):
        review.prepare(review.hydrate(review.read(review.write(doc(**change))), side), 2)


def test_tampering():
    text, side = review.split(doc(), VECS)
    edited = doc()
    edited["raw_tracks"]["1"]["start_time"] = 0.25
    with pytest.raises(review.ReviewError, match="edited"):
        review.hydrate(review.read(review.write(edited)), side)
    other = json.loads(side)
    del other["tracks"]["2"]
    with pytest.raises(review.ReviewError, match="only"):
        review.hydrate(review.read(text), json.dumps(other))
    with pytest.raises(review.ReviewError, match="video_id"):
        review.hydrate(review.read(text), json.dumps(json.loads(side) | {"video_id": "w"}))
    bad = doc()
    bad["raw_tracks"]["1"]["internal_vector"] = [1]
    with pytest.raises(review.ReviewError, match="internal"):
        review.read(review.write(bad))


def test_jpegs():
    assert media.split_jpegs(b"\0\0\xff\xd8\1\2\3\xff\xd9\0\0") == [b"\xff\xd8\1\2\3\xff\xd9"]
    assert media.split_jpegs(b"\xff\xd8\1") == [] and len(media.split_jpegs(b"\xff\xd8\xff\xd9" * 3 + b"\xff\xd8")) == 3


def test_video_ids():
    small = lambda b, name="A.mp4": media.video_id(name, len(b), lambda o, n: b[o : o + n])
    assert small(b"x") == small(b"x", "dir/a.MP4") != small(b"xy")
    big = bytearray(17 * media.MIB)
    before = small(bytes(big))
    big[3 * media.MIB] = 1
    assert small(bytes(big)) != before


def test_worker_stream():
    faces = [{"box": (1, 2, 3, 4), "vec": [0.5] * constants.EMBEDDING_DIM, "quality": 0.25, "thumb": b"jpg"}]
    data = media.encode_faces(faces)
    got = media.decode_faces(data)
    assert got[0]["box"] == (1, 2, 3, 4) and got[0]["thumb"] == b"jpg" and got[0]["vec"].tolist() == faces[0]["vec"]
    with pytest.raises(media.StreamError):
        media.decode_faces(data[:-2])
    with pytest.raises(media.StreamError, match="no face"):
        media.decode_faces(b"\0\0\0\x0c\x01\0\0\0\x07no face")


def test_new_identity_may_not_have_the_label_of_an_existing_one():
    r = {"track_id": "1", "action": "new_identity", "identity": "identity 7", "variant": "", "vec": [1.0], "count": 1, "start_time": 0.0, "end_time": 1.0, "group": 1}
    review.validate(r, 1, lambda i: i != 7)
    with pytest.raises(review.ReviewError):
        review.validate(r, 1, lambda i: i == 7)


def test_review_without_ids_is_refused():
    doc = {"review_id": "", "video_id": "v", "input_path": "/x.mp4", "raw_tracks": {}}
    with pytest.raises(review.ReviewError, match="review_id"):
        review.hydrate(doc, '{"review_id": "", "video_id": "v", "input_path": "/x.mp4", "tracks": {}}')
