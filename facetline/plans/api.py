"""What a user calls: scans, reviews, commits, searches, lists and redactions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetline.functions import exprs as X
from facetline.functions.constants import EMBEDDING_DIM, MATCH_THRESHOLD
from facetline.kernels import redaction, tracker
from facetline.operators import aggregates, detect, joins, search, video
from facetline.plans import options as O
from facetline.sources import files, review
from facetline.store import commits
from facetline.store.snapshot import Store


def _variants(store: Store) -> DataFrame:
    return store.table("variants").select(F.col("id").cast("long").alias("variant_id"), F.col("embedding").alias("vec"))


def scan(store: Store, detections: DataFrame, options: tracker.Options | None = None, complete: bool = True) -> DataFrame:
    """Staged scan: tracks with the actions to review and their potential identities. Nothing is written."""
    o = options or tracker.Options()
    known = video.with_known(video.valid(detections), _variants(store), o.threshold)
    empty = detections.where("face_idx is null").withColumn("known", F.lit(-1).cast("long"))
    rows = known.select("video_id", "frame_index", "face_idx", "vec", "quality", "known").unionByName(empty.select("video_id", "frame_index", "face_idx", "vec", "quality", "known"))
    tracks = video.stage(video.track_videos(rows, o, complete), _variants(store), o.threshold)
    groups = video.regroup_videos(tracks).select("video_id", "track_id", "potential_id", F.col("status").alias("link"))
    return tracks.join(groups, ["video_id", "track_id"], "left")


def review_document(tracks: DataFrame, video_id: str, input_path: str, review_id: str | None = None) -> tuple[str, str]:
    """The YAML and JSON of one video's staged tracks."""
    rows = tracks.where(F.col("video_id") == video_id).orderBy("track_id").collect()  # one video's tracks, for a person to read
    raw, groups, vectors = {}, {}, {}
    for r in rows:
        raw[str(r.track_id)] = {"start_time": r.start_time, "end_time": r.end_time, "nearest_candidates": [], "confidence": r.confidence or 0.0, "suggested_action": r.action or ""}
        vectors[str(r.track_id)] = (r.vec, r["count"])
        if r.potential_id is not None:
            groups.setdefault(r.potential_id, []).append(r)
    doc = {"review_id": review_id or review.new_review_id(), "video_id": video_id, "input_path": input_path, "raw_tracks": raw, "unresolved_tracks": [str(r.track_id) for r in rows if r.potential_id is None]}
    agree = lambda g: g[0].action if len({x.action for x in g}) == 1 and g[0].action == "new_identity" else ""
    doc["potential_identities"] = [{"id": n, "tracks": [str(x.track_id) for x in g], "identity": "", "variant": "", "action": agree(g)} for n, g in sorted(groups.items())]
    return review.split(doc, vectors)


def commit(store: Store, text: str, sidecar: str, dim: int) -> str:
    """Commits a reviewed document."""
    doc = review.read(text)

    def exists(identity: int) -> bool:
        return not store.table("identities").where(F.col("id") == identity).isEmpty()

    return commits.apply(store, doc["video_id"], doc["input_path"], review.prepare(review.hydrate(doc, sidecar), dim, exists))


rollback = commits.revert


def find(store: Store, vec: list[float], threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """Where the person of a vector appears: all intervals of the nearest variant's identity; empty if none is near."""
    O.fraction(threshold, "match threshold")
    q = store.spark.createDataFrame([(1, list(map(float, vec)))], "query_id long, vec array<double>")
    hit = search.closest(q, _variants(store), threshold).first()
    v = store.table("variants")
    owner = v.where(F.col("id") == hit.variant_id).first()
    return joins.timeline(store.table("face_intervals"), v, store.table("video_metadata"), owner.identity_id if owner else -1).orderBy("path", "video_id", "start_time")


def find_image(store: Store, image: bytes, load: Callable[[], Callable[[bytes], list[dict]]], threshold: float = MATCH_THRESHOLD, dim: int = EMBEDDING_DIM) -> DataFrame | None:
    """find() of the largest face of an image, the first on ties, as the detector that load() makes sees it; None if it
    sees none."""
    O.fraction(threshold, "match threshold")
    frame = store.spark.createDataFrame([("", 0, bytearray(image))], "video_id string, frame_index long, data binary")
    faces = detect.detect(frame, load, dim=dim).where("face_idx is not null").collect()  # of one image
    if not faces:
        return None
    best = video.largest_face(store.spark.createDataFrame(faces, detect.FULL)).first()
    return find(store, best.vec, threshold)


def list_identities(store: Store, limit: int = 0, offset: int = 0, name: str = "") -> DataFrame:
    out = aggregates.identity_summary(store.table("identities"), store.table("variants"))
    if name:
        out = out.where(F.col("name").ilike(f"%{name}%"))
    out = out.orderBy("id").offset(offset)
    return out.limit(limit) if limit else out


def list_variants(store: Store, identity: int) -> DataFrame:
    out = store.table("variants").where(F.col("identity_id") == identity)
    if out.isEmpty() and store.table("identities").where(F.col("id") == identity).isEmpty():
        raise commits.CommitError(f"identity {identity} not found")
    return out.select("id", X.display_variant(F.col("name")).alias("name"), "face_count", "created_at").orderBy("id")


def list_commits(store: Store, limit: int = 0) -> DataFrame:
    out = aggregates.commit_summary(store.table("commits"), store.table("ledger_entries")).orderBy(F.desc("created_at"), "id")
    return out.limit(limit) if limit else out


def ledger(store: Store, commit_id: str) -> DataFrame:
    return store.table("ledger_entries").where(F.col("commit_id") == commit_id).orderBy(F.desc("id"))


def redact(store: Store, detections: DataFrame, identities: list[int], options: redaction.Options | None = None) -> DataFrame:
    """The boxes to hide for these identities; an identity without a variant raises before any frame is read."""
    wanted = store.spark.createDataFrame([(i,) for i in identities], "identity_id int")
    v = store.table("variants")
    if missing := [r.identity_id for r in video.missing_targets(wanted, v).collect()]:
        raise commits.CommitError(f"no variants of {missing}")
    own = v.where(F.col("identity_id").isin(identities)).orderBy("id").select("identity_id", "embedding").collect()  # the stated targets
    return video.redaction_plan(detections, [(r.identity_id, r.embedding) for r in own], options)


def reset(store: Store, output: str, tables: bool = False, outputs: bool = False, debug: bool = False, confirm: Callable[[str], bool] = lambda question: False) -> list[str]:
    """Clears the tables, the output files and the debug frames, or all of these if none is named; each only if confirm
    says so. Tables are cleared by an empty version. Returns what went."""
    if not (tables or outputs or debug):
        tables = outputs = debug = True
    gone = []
    if tables and confirm("Drop all tables?"):
        store.reset()
        gone.append("tables")
    return gone + files.reset_files(files.Files(store.spark, output), outputs, debug, confirm)
