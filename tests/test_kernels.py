import numpy as np
import pytest

from facetline.kernels import pixels, redaction, regroup, tracker
from facetline.kernels.vectors import distance


def v(*x):
    return np.array(x, float)


@pytest.mark.parametrize("a,b,d", [((1, 0), (1, 0), 0), ((1, 0), (0, 1), 1), ((1, 0), (-1, 0), 2), ((1, 0), (5, 0), 0), ((), (), 1), ((0, 0), (1, 0), 1), ((1, 0), (1, 0, 0), 1)])
def test_distance(a, b, d):
    assert distance(v(*a), v(*b)) == pytest.approx(d)


def opts(**k):
    return tracker.Options(**({"fps": 10.0, "grace": 1.0, "blip": 0.0} | k))


def test_tracks_expire_before_they_are_matched():
    t = tracker.Tracker(opts())
    t.step(0, [tracker.Face(v(1, 0), 1.0, 42)])
    closed = t.step(25, [tracker.Face(v(1, 0), 1.0)])
    assert [c.ident for c in closed] == [42] and [c.ident for c in t.open] == [-1]


def test_a_variant_has_one_open_track():
    t = tracker.Tracker(opts())
    t.step(0, [tracker.Face(v(1, 0), 1.0, 7)])
    t.step(1, [tracker.Face(v(0, 1), 1.0, 7)])
    assert [x.ident for x in t.open] == [7, -1]


@pytest.mark.parametrize("flip", [False, True])
def test_the_nearest_face_wins_a_conflict_whatever_the_order(flip):
    t = tracker.Tracker(opts())
    t.step(0, [tracker.Face(v(1, 0), 0.8, 11)])
    faces = [tracker.Face(v(0.8, 0.6), 0.7, 3), tracker.Face(v(1, 0), 0.95, 4)]
    t.step(1, faces[::-1] if flip else faces)
    known = next(x for x in t.open if x.ident == 11)
    assert known.final[0] == 0.95 and [x.final[0] for x in t.open if x.ident < 0] == [0.7]


def test_means_samples_and_top():
    t = tracker.Track.open(1, 0, tracker.Face(v(1, 0), 1.0))
    for f, q in enumerate([1.05, 1.2, 1.25, 0.9], 1):
        t.add(f, tracker.Face(v(0, 1), q))
    assert t.mean == pytest.approx([0.2, 0.8]) and [s[0] for s in t.samples] == [0, 2, 4]
    assert t.best == (1.25, 3) and t.lowest == (0.9, 4) and t.representative() == 1


def test_missing_frames_raise():
    tracker.check_frames([0, 2, 4], 2)
    with pytest.raises(ValueError, match="frame 2"):
        tracker.check_frames([0, 4], 2)


def items(*rows):
    return [regroup.Item(i, s, e, v(*x)) for i, s, e, x in rows]


def clusters(*rows):
    out = []
    for n, (i, s, e, x) in enumerate(rows, 1):
        c = regroup.Cluster(n)
        c.put(regroup.Item(i, s, e, v(*x)), regroup.Link("NEW"))
        out.append(c)
    return out


@pytest.mark.parametrize("x,status", [((0.98, 0.2), "STRONG"), ((0.74, 0.67), "POSSIBLE"), ((0, 1), "NEW")])
def test_link(x, status):
    how, _ = regroup.link(regroup.Item(2, 3, 5, v(*x)), clusters((1, 0, 2, (1, 0))))
    assert how.status == status


def test_ambiguous_and_blocked():
    two = clusters((1, 0, 1, (0.819, 0.574)), (2, 2, 3, (0.819, -0.574)))
    how, _ = regroup.link(regroup.Item(3, 4, 5, v(1, 0)), two)
    assert (how.status, how.best, how.second) == ("AMBIGUOUS", 1, 2)
    how, _ = regroup.link(regroup.Item(2, 1, 3, v(0.98, 0.2)), clusters((1, 0, 2, (1, 0))))
    assert (how.status, how.blocked, how.blocked_track) == ("NEW", 1, 1)


def groups(g):
    return [sorted(c.members) for c in g.clusters], sorted(g.unresolved)


def test_greedy():
    assert groups(regroup.greedy(items((1, 0, 1, (1, 0)), (2, 2, 3, (0.98, 0.2)), (3, 4, 5, (0, 1))))) == ([[1, 2], [3]], [])
    g = regroup.greedy(items((1, 0, 1, (0.819, 0.574)), (2, 2, 3, (0.819, -0.574)), (3, 4, 5, (1, 0)), (4, 6, 7, (1, 0))))
    assert groups(g) == ([[1], [2]], [3, 4])


def test_refinement_moves_drops_and_attaches():
    def grouping(first, possible, others=()):
        c = regroup.Cluster(1)
        for k, x in enumerate(first, 1):
            c.put(regroup.Item(k, 10 * k, 10 * k + 1, v(*x)), regroup.Link("NEW"))
        if possible:
            c.put(regroup.Item(20, 200, 201, v(*possible)), regroup.Link("POSSIBLE"))
        rest = []
        for n, x in enumerate(others, 2):
            d = regroup.Cluster(n)
            d.put(regroup.Item(100 * n, 1000 * n, 1000 * n + 1, v(*x)), regroup.Link("NEW"))
            rest.append(d)
        return regroup.Grouping([c, *rest], {})

    g = grouping([(1, 0)], (0.66, 0.75), [(0, 1)])
    assert regroup._review_possible(g) and 20 in g.clusters[1].members
    g = grouping([(1, 0)], (0.60, 0.80))
    assert regroup._review_possible(g) and g.unresolved[20][1].status == "NEW"
    g = grouping([(1, 0), (0.95, 0.1)], None, [(0.819, -0.574)])
    g.unresolved[30] = (regroup.Item(30, 300, 301, v(0.98, 0.05)), regroup.Link("AMBIGUOUS"))
    assert regroup._review_unresolved(g, False) and 30 in g.clusters[0].members


def test_centroid_is_weighted():
    c = regroup.Cluster(1)
    c.put(regroup.Item(1, 0, 1, v(1, 0), 2), regroup.Link("NEW"))
    c.put(regroup.Item(2, 2, 3, v(0, 1), 1), regroup.Link("NEW"))
    m, n = c.centroid()
    assert n == 3 and m == pytest.approx([2 / 3, 1 / 3])
    assert "Potential identity 1: 2 track(s)" in regroup.report(regroup.Grouping([c], {}))


def redact(targets, frames, **k):
    o = redaction.Options(**({"fps": 1.0, "linger": 1.0, "scale": 1.0} | k))
    r = redaction.Redactor(o, targets)
    return [[b for b, _ in r.step(i, faces, 6, 6)] for i, faces in enumerate(frames)]


A, B = v(1, 0), v(0, 1)


def test_targets_linger():
    out = redact([(1, A)], [[((0, 0, 2, 2), A), ((4, 4, 6, 6), B)], [], []])
    assert out == [[(0, 0, 2, 2)], [(0, 0, 2, 2)], []]


def test_several_instances():
    out = redact([(1, A)], [[((0, 0, 2, 2), A), ((4, 0, 6, 2), A)], [((4, 0, 6, 2), A)]])
    assert sorted(out[1]) == [(0, 0, 2, 2), (4, 0, 6, 2)]


def test_paranoid_modes():
    out = redact([(1, A)], [[((0, 0, 2, 2), A)], [((3, 1, 5, 3), B)]], linger=2.0, paranoid=True)
    assert sorted(out[1]) == [(0, 0, 2, 2), (3, 1, 5, 3)]
    out = redact([(1, A)], [[((0, 0, 2, 2), A), ((4, 0, 6, 2), A)], [((4, 0, 6, 2), A), ((2, 2, 4, 4), B)]], linger=2.0, paranoid=True)
    assert sorted(out[1]) == [(0, 0, 2, 2), (2, 2, 4, 4), (4, 0, 6, 2)]
    assert redact([(1, A)], [[((3, 1, 5, 3), B)]], strict=True) == [[(3, 1, 5, 3)]]
    assert redact([], [[((3, 1, 5, 3), None)]], mode="blur-all") == [[(3, 1, 5, 3)]]


def test_boxes():
    assert redaction.scaled((1, 1, 3, 3), 2.0, 4, 4) == (0, 0, 4, 4)
    assert redaction.scaled((-2, -2, 2, 2), 1, 4, 4) == (0, 0, 2, 2)


def full(h, w, colour):
    img = np.zeros((h, w, 4), np.uint8)
    img[:] = colour
    return img


def test_black_clips():
    img = pixels.paint(full(4, 4, (10, 20, 30, 255)), [(-2, -2, 2, 2)], "black")
    assert (img[:2, :2] == (0, 0, 0, 255)).all() and (img[2:] == (10, 20, 30, 255)).all() and (img[:2, 2:] == (10, 20, 30, 255)).all()


def test_pixel_blocks():
    img = full(4, 4, (0, 0, 0, 255))
    img[..., 0] = (np.arange(16) * 10 + 10).reshape(4, 4)
    pixels.paint(img, [(0, 0, 4, 4)], "pixel", 2)
    assert [int(img[y, x, 0]) for y in (0, 2) for x in (0, 2)] == [10, 30, 90, 110] and img[1, 1, 0] == 10


def test_secure_takes_the_ring():
    img = full(5, 5, (40, 90, 130, 255))
    img[1:4, 1:4] = (200, 1, 1, 255)
    pixels.paint(img, [(1, 1, 4, 4)], "secure")
    assert (img == (40, 90, 130, 255)).all()
    whole = pixels.paint(full(2, 2, (9, 9, 9, 255)), [(0, 0, 2, 2)], "secure")
    assert (whole == (0, 0, 0, 255)).all()


def test_gauss_stays_in_the_box():
    img = full(5, 5, (100, 100, 100, 255))
    img[1:4, 1:4, :3] = np.where((np.indices((3, 3)).sum(0) % 2)[..., None], 255, 0)
    before = img.copy()
    pixels.paint(img, [(1, 1, 4, 4)], "gauss", 1)
    outside = np.ones((5, 5), bool)
    outside[1:4, 1:4] = False
    assert (img[outside] == before[outside]).all() and img[2, 2, 0] != before[2, 2, 0] and (img[..., 3] == 255).all()


def test_distances_at_once_are_those_one_by_one():
    from facetline.kernels import vectors

    rng = np.random.default_rng(5)
    rows = [*rng.normal(size=(20, 6)), np.zeros(6), None, [], rng.normal(size=5)]
    rows += [rows[3], [2 * x for x in rows[3]]]
    for a in (rng.normal(size=6), np.zeros(6), rng.normal(size=5), None, []):
        assert np.allclose(vectors.distances(a, rows), [vectors.distance(a, r) for r in rows], atol=1e-12)
    assert vectors.nearest(rows[3], rows, 0.5) == 3 and vectors.nearest(rows[3], [], 0.5) == -1
    assert len(set(vectors.distances(rng.normal(size=6), [rows[3]] * 9))) == 1
