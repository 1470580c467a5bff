"""The sequential kernels per video: one group per video, parallel across videos.

A group holds one video's rows. Videos too long for a worker's memory take the streaming path, which carries the same
kernel's state from batch to batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetline.functions import exprs as X
from facetline.kernels import pixels, redaction, regroup, tracker
from facetline.operators import search

TRACKS = "video_id string, track_id int, ident long, start_time double, end_time double, vec array<double>, count int, best_frame long, lowest_frame long, final_frame long, representative_frame long, samples array<long>"
GROUPS = "video_id string, track_id int, potential_id int, cluster_id int, status string, best_id int, best_score double, second_id int, blocked_id int, blocked_track int"
PLAN = "video_id string, frame_index long, pos int, x1 int, y1 int, x2 int, y2 int, reason string"


def valid(detections: DataFrame) -> DataFrame:
    """Detections with a box at least a pixel wide and high, and a vector that has a direction."""
    norm = F.sqrt(F.aggregate(F.transform(F.col("vec").cast("array<double>"), lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    return detections.where((F.col("x2") - F.col("x1") >= 1) & (F.col("y2") - F.col("y1") >= 1) & (norm > 1e-6))


def largest_face(detections: DataFrame) -> DataFrame:
    """One face per frame: the largest box, the first on ties."""
    area = F.abs((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    best = detections.groupBy("video_id", "frame_index").agg(F.max(F.struct(area.alias("area"), (-F.col("face_idx")).alias("first"))).alias("m"))
    best = best.select("video_id", "frame_index", (-F.col("m.first")).alias("face_idx"))
    return detections.join(best, ["video_id", "frame_index", "face_idx"], "left_semi")


def sample_frames(frames: DataFrame, nth: int) -> DataFrame:
    """Every nth frame: the modulo reaches the scan as a filter."""
    return frames.where(F.col("frame_index") % nth == 0)


def with_known(detections: DataFrame, variants: DataFrame, threshold: float) -> DataFrame:
    """Detections with known: the closest variant below the threshold, or -1; one batched search, not one per face."""
    d = detections.withColumn("query_id", F.xxhash64("video_id", "frame_index", "face_idx"))
    best = search.closest(d.select("query_id", "vec"), variants, threshold).select("query_id", F.col("variant_id").alias("known"))
    return d.join(best, "query_id").drop("query_id")


def _frames(p: pd.DataFrame) -> list[tuple[int, pd.DataFrame]]:
    return [(int(f), g) for f, g in p.sort_values(["frame_index", "face_idx"], kind="stable").groupby("frame_index", sort=True)]


def track_videos(detections: DataFrame, options: tracker.Options | None = None, complete: bool = False) -> DataFrame:
    """TRACKS of each video. detections: (video_id, frame_index, face_idx, vec, quality, known); a frame without faces is
    a row whose face_idx is null. With complete, a missing frame raises, and nothing is made of any video."""
    o = options or tracker.Options()

    def run(p: pd.DataFrame) -> pd.DataFrame:
        frames = _frames(p)
        if complete:
            tracker.check_frames([f for f, _ in frames], o.nth)
        t, out = tracker.Tracker(o), []
        for f, g in frames:
            g = g[g["face_idx"].notna()]
            out += t.step(f, [tracker.Face(np.asarray(v, float), float(q), int(k)) for v, q, k in zip(g["vec"], g["quality"], g["known"], strict=True)])
        return tracks_frame(t, out + t.finish(), str(p["video_id"].iloc[0]))

    cols = detections.select("video_id", "frame_index", "face_idx", "vec", "quality", "known")
    return cols.groupBy("video_id").applyInPandas(run, TRACKS)


def tracks_frame(t: tracker.Tracker, closed: list[tracker.Track], video: str, first: int = 1) -> pd.DataFrame:
    """Rows of TRACKS, numbered in the order of closing; blips are dropped and take no number."""
    rows = []
    for x in closed:
        span = t.span(x)
        if span:
            rows.append((video, first + len(rows), x.ident, *span, x.mean.tolist(), x.count, x.best[1], x.lowest[1], x.final[1], x.representative(), [f for f, _ in x.samples]))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in TRACKS.split(", ")])


def stage(tracks: DataFrame, variants: DataFrame, threshold: float) -> DataFrame:
    """tracks with their two nearest variants' distances, confidence and the action to review."""
    q = tracks.withColumn("query_id", F.xxhash64("video_id", "track_id"))
    acts = search.staged_actions(q.select("query_id", "vec"), variants, threshold)
    return q.join(acts, "query_id").drop("query_id").withColumn("review", X.needs_review(F.col("action")))


def regroup_videos(tracks: DataFrame, rounds: int = 3, strict_overlap: bool = False) -> DataFrame:
    """GROUPS: each track's potential identity (renumbered from 1), or null where it is unresolved."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        items = [regroup.Item(int(i), float(s), float(e), np.asarray(v, float), int(n)) for i, s, e, v, n in zip(p["track_id"], p["start_time"], p["end_time"], p["vec"], p["count"], strict=True)]
        g, rows, video = regroup.regroup(items, rounds, strict_overlap), [], str(p["video_id"].iloc[0])

        def row(ident: int, n: int | None, c: int | None, how: regroup.Link) -> tuple:
            return video, ident, n, c, how.status, how.best, how.best_score, how.second, how.blocked, how.blocked_track

        for n, c in g.renumbered():
            rows += [row(i, n, c.ident, c.links[i]) for i in c.members]
        rows += [row(i, None, None, how) for i, (_, how) in g.unresolved.items()]
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in GROUPS.split(", ")])
        return out.astype({c: "Int32" for c in ("potential_id", "cluster_id", "best_id", "second_id", "blocked_id", "blocked_track")})

    return tracks.select("video_id", "track_id", "start_time", "end_time", "vec", "count").groupBy("video_id").applyInPandas(run, GROUPS)


def redaction_plan(detections: DataFrame, targets: list[tuple[int, list[float]]], options: redaction.Options | None = None) -> DataFrame:
    """PLAN: the boxes to hide, in painting order. detections: (video_id, frame_index, width, height, face_idx, x1..y2,
    vec), frames without faces as rows whose face_idx is null. targets: the stated list of (identity, vector)."""
    o = options or redaction.Options()
    wanted = [(i, np.asarray(v, float)) for i, v in targets]

    def run(p: pd.DataFrame) -> pd.DataFrame:
        r, rows = redaction.Redactor(o, wanted), []
        for f, g in _frames(p):
            w, h = int(g["width"].iloc[0]), int(g["height"].iloc[0])
            g = g[g["face_idx"].notna()]
            faces = [((int(a), int(b), int(c), int(d)), None if v is None else np.asarray(v, float)) for a, b, c, d, v in zip(g["x1"], g["y1"], g["x2"], g["y2"], g["vec"], strict=True)]
            rows += [(str(p["video_id"].iloc[0]), f, k, *box, why) for k, (box, why) in enumerate(r.step(f, faces, w, h))]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PLAN.split(", ")])

    cols = ["video_id", "frame_index", "width", "height", "face_idx", "x1", "y1", "x2", "y2", "vec"]
    return detections.select(cols).groupBy("video_id").applyInPandas(run, PLAN)


def missing_targets(wanted: DataFrame, variants: DataFrame) -> DataFrame:
    """The identities that no variant has: a redaction must not start with one."""
    return wanted.join(variants.select("identity_id"), "identity_id", "left_anti")


def paint_frames(frames: DataFrame, plan: DataFrame, style: str = "pixel", strength: int = 15) -> DataFrame:
    """frames (video_id, frame_index, width, height, data as RGBA) with the boxes of the plan painted. A frame meets its
    own boxes only, which are as many as its faces."""
    boxes = plan.groupBy("video_id", "frame_index").agg(F.array_sort(F.collect_list(F.struct("pos", "x1", "y1", "x2", "y2"))).alias("boxes"))

    def run(batches):
        for p in batches:
            data = []
            for raw, w, h, bs in zip(p["data"], p["width"], p["height"], p["boxes"], strict=True):
                img = np.frombuffer(raw, np.uint8).reshape(h, w, 4).copy()
                data.append(pixels.paint(img, [(b["x1"], b["y1"], b["x2"], b["y2"]) for b in (bs if bs is not None else [])], style, strength).tobytes())
            yield p.drop(columns=["boxes"]).assign(data=data)

    joined = frames.join(boxes, ["video_id", "frame_index"], "left").select("video_id", "frame_index", "width", "height", "data", "boxes")
    return joined.mapInPandas(run, "video_id string, frame_index long, width int, height int, data binary")
