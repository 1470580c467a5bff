"""Commits of reviewed tracks, their rollback, and edits of identities. Each call publishes one version or raises."""

from __future__ import annotations

import datetime as dt
import re
import uuid

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from facetline.operators import dml
from facetline.store.schema import TABLES
from facetline.store.snapshot import Store, cascade

LABEL = re.compile(r"(?i)^identity (\d+)$")


class CommitError(ValueError):
    pass


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def _next(df: DataFrame) -> int:
    return (df.agg(F.max("id")).first()[0] or 0) + 1


def _frame(store: Store, table: str, rows: list[tuple]) -> DataFrame:
    return store.spark.createDataFrame(rows, TABLES[table])


def merged(mean, n: int, delta, dn: int) -> list[float] | None:
    """The stored mean after adding a sum and a count; null if no faces are left. float32 where it is stored."""
    if n + dn <= 0:
        return None
    a, b = np.asarray(mean, float), np.asarray(delta, float)
    if len(a) != len(b):
        raise CommitError(f"vector has {len(b)} dimensions, not {len(a)}")
    return ((a * n + b) / (n + dn)).astype(np.float32).astype(float).tolist()


class _Edit:
    """The variants and identities that one commit touches, on the driver: they are as many as its reviewed tracks.

    Names are looked up by filters that Spark runs over the tables; nothing else is brought here.
    """

    def __init__(self, store: Store):
        self.store, self.version = store, store.version()
        self.t = store.tables(self.version)
        self.next = {n: _next(self.t[n]) for n in ("identities", "variants", "ledger_entries", "face_intervals", "commit_interval_snapshots")}
        self.identities: dict[int, tuple] = {}
        self.variants: dict[int, list] = {}
        self.gone: set[int] = set()
        self.ledger: list[tuple] = []
        self.now = _now()

    def take(self, table: str) -> int:
        self.next[table] += 1
        return self.next[table] - 1

    def identity(self, label: str) -> int | None:
        """By name, whatever its case, or by a label like "Identity 7"."""
        label = label.strip()
        for i, (_, name, _) in self.identities.items():
            if name is not None and name.lower() == label.lower():
                return i
        row = self.t["identities"].where(F.lower("name") == label.lower()).orderBy("id").first()
        if row is None and (m := LABEL.match(label)):
            if int(m[1]) in self.identities:
                return int(m[1])
            row = self.t["identities"].where(F.col("id") == int(m[1])).first()
        return row and row.id

    def variant(self, identity: int, name: str) -> list | None:
        for v in self.variants.values():
            if v[1] == identity and (v[2] or "Default").lower() == name.strip().lower():
                return v
        row = self.t["variants"].where((F.col("identity_id") == identity) & (F.lower(F.coalesce("name", F.lit("Default"))) == name.strip().lower())).orderBy("id").first()
        return row and self.variants.setdefault(row.id, list(row))

    def by_id(self, ident: int) -> list | None:
        if ident in self.variants:
            return self.variants[ident]
        row = self.t["variants"].where(F.col("id") == ident).first()
        return row and self.variants.setdefault(ident, list(row))

    def add_identity(self, name: str | None) -> int:
        i = self.take("identities")
        self.identities[i] = (i, name or None, self.now)
        return i

    def add_variant(self, identity: int, name: str, vec, n: int) -> list:
        if self.variant(identity, name):
            raise CommitError(f"variant {name!r} exists")
        i = self.take("variants")
        self.variants[i] = [i, identity, name, np.asarray(vec, np.float32).astype(float).tolist(), n, self.now]
        return self.variants[i]

    def log(self, commit: str, track: str, variant: int, vec, n: int) -> None:
        added = (np.asarray(vec, float) * n).astype(np.float32).astype(float).tolist()
        self.ledger.append((self.take("ledger_entries"), commit, track, variant, added, n, self.now))

    def changed(self) -> set[str]:
        """Puts the edited rows into the tables; an emptied variant goes, and its identity if it has no other."""
        names: set[str] = set()
        if self.identities:
            self.t["identities"] = dml.upsert(self.t["identities"], _frame(self.store, "identities", list(self.identities.values())), "id")
            names.add("identities")
        if self.variants:
            kept = [tuple(v) for i, v in self.variants.items() if i not in self.gone]
            old = self.t["variants"].where(~F.col("id").isin(list(self.variants)))
            self.t["variants"] = old.unionByName(_frame(self.store, "variants", kept))
            names.add("variants")
        if self.gone:
            owners = sorted({self.variants[i][1] for i in self.gone if self.variants[i][1] is not None})
            left = [r.identity_id for r in self.t["variants"].where(F.col("identity_id").isin(owners)).select("identity_id").distinct().collect()]
            empty = [i for i in owners if i not in left]
            self.t["identities"] = self.t["identities"].where(~F.col("id").isin(empty))
            names.add("identities")
        if self.ledger:
            self.t["ledger_entries"] = self.t["ledger_entries"].unionByName(_frame(self.store, "ledger_entries", self.ledger))
            names.add("ledger_entries")
        return cascade(self.t, names) if self.gone else names

    def publish(self, names: set[str]) -> int:
        return self.store.publish({n: self.t[n] for n in names}, self.version)


def apply(store: Store, video_id: str, path: str, actions: list[dict], commit_id: str | None = None) -> str:
    """One commit: the video's state is kept for a rollback, actions run by phase, and its intervals are replaced.

    actions: track_id, action, identity, variant, vec, count, start_time, end_time, and target_track for merges into a
    track of the same commit. Discarded tracks have no interval. Any error leaves the store as it was.
    """
    e, commit = _Edit(store), commit_id or str(uuid.uuid4())
    if not e.t["commits"].where(F.col("id") == commit).isEmpty():
        raise CommitError(f"commit {commit} exists")
    names = {"commits", "commit_video_snapshots", "commit_interval_snapshots", "video_metadata", "face_intervals"}
    e.t["commits"] = e.t["commits"].unionByName(_frame(store, "commits", [(commit, "active", e.now)]))
    meta = e.t["video_metadata"].where(F.col("id") == video_id).first()
    e.t["commit_video_snapshots"] = e.t["commit_video_snapshots"].unionByName(_frame(store, "commit_video_snapshots", [(commit, video_id, meta is not None, meta and meta.path, meta and meta.indexed_at)]))
    old = e.t["face_intervals"].where(F.col("video_id") == video_id)
    # ids follow the order of the intervals, which are those of one video
    from pyspark.sql import Window

    first = e.next["commit_interval_snapshots"]
    snap = old.withColumn("sid", F.row_number().over(Window.partitionBy("video_id").orderBy("start_time", "end_time", "id")) + (first - 1))
    e.t["commit_interval_snapshots"] = e.t["commit_interval_snapshots"].unionByName(snap.select(F.col("sid").cast("long").alias("id"), F.lit(commit).alias("commit_id"), "video_id", "start_time", "end_time", "face_count", "variant_id"))
    e.t["video_metadata"] = dml.upsert(e.t["video_metadata"], _frame(store, "video_metadata", [(video_id, path, e.now)]), "id")

    of_track: dict[str, int] = {}
    order = {a: i for i, a in enumerate(dml.PHASES)}
    for a in sorted(actions, key=lambda a: order.get(a["action"], len(order))):
        if a["action"] == "discard":
            continue
        of_track[a["track_id"]] = _act(e, commit, a, of_track)
    rows = []
    for a in actions:
        if a["action"] != "discard":
            rows.append((e.take("face_intervals"), video_id, float(a["start_time"]), float(a["end_time"]), int(a["count"]), of_track[a["track_id"]]))
    e.t["face_intervals"] = e.t["face_intervals"].where(F.col("video_id") != video_id).unionByName(_frame(store, "face_intervals", rows))
    e.publish(names | e.changed())
    return commit


def _act(e: _Edit, commit: str, a: dict, of_track: dict[str, int]) -> int:
    name, variant = (a.get("identity") or "").strip(), (a.get("variant") or "").strip()
    n, vec, kind = int(a["count"]), a["vec"], a["action"]
    if kind == "new_identity":
        if name and e.identity(name) is not None:
            raise CommitError(f"identity {name!r} exists")
        v = e.add_variant(e.add_identity(name), variant or "Default", vec, n)
    elif kind == "new_variant":
        if (i := e.identity(name)) is None:
            raise CommitError(f"identity {name!r} not found")
        v = e.add_variant(i, variant, vec, n)
    elif kind == "merge":
        if a.get("target_track"):
            if a["target_track"] not in of_track:
                raise CommitError(f"track {a['target_track']} has no variant")
            v = e.by_id(of_track[a["target_track"]])
        else:
            if (i := e.identity(name)) is None:
                raise CommitError(f"identity {name!r} not found")
            v = e.variant(i, variant or "Default")
        if v is None:
            raise CommitError(f"variant {variant!r} not found")
        v[3], v[4] = merged(v[3], v[4], np.asarray(vec, float) * n, n), v[4] + n
    else:
        raise CommitError(f"unknown action {kind!r}")
    e.log(commit, a["track_id"], v[0], vec, n)
    return v[0]


def revert(store: Store, commit_id: str) -> None:
    """Restores the video's intervals and metadata, and takes the commit's sums out of the variants, last first."""
    e = _Edit(store)
    t = e.t
    c = t["commits"].where(F.col("id") == commit_id).first()
    if c is None:
        raise CommitError(f"commit {commit_id} not found")
    if c.status in ("rolled_back", "processing"):
        raise CommitError(f"commit {commit_id} is {c.status}")
    snap = t["commit_video_snapshots"].where(F.col("commit_id") == commit_id).first()
    if snap:
        later = t["commits"].where((F.col("created_at") > F.lit(c.created_at)) & F.col("status").isin("active", "processing", "rolling_back"))
        same = t["commit_video_snapshots"].where(F.col("video_id") == snap.video_id).select(F.col("commit_id").alias("id"))
        newer = later.join(same, "id", "left_semi").orderBy("created_at", "id").first()
        if newer:
            raise CommitError(f"newer active commit {newer.id} has the same video")
        before = t["commit_interval_snapshots"].where(F.col("commit_id") == commit_id)
        from pyspark.sql import Window

        back = before.withColumn("nid", F.row_number().over(Window.partitionBy("commit_id").orderBy("id")) + (e.next["face_intervals"] - 1))
        back = back.select(F.col("nid").cast("long").alias("id"), "video_id", "start_time", "end_time", "face_count", "variant_id")
        t["face_intervals"] = t["face_intervals"].where(F.col("video_id") != snap.video_id).unionByName(back)
        rest = t["video_metadata"].where(F.col("id") != snap.video_id)
        old = [(snap.video_id, snap.previous_path, snap.previous_indexed_at)] if snap.had_metadata else []
        t["video_metadata"] = rest.unionByName(_frame(store, "video_metadata", old))
    entries = t["ledger_entries"].where(F.col("commit_id") == commit_id).orderBy(F.desc("id")).collect()  # one commit's tracks
    for x in entries:
        v = e.by_id(x.variant_id)
        if v is None or x.variant_id in e.gone:
            continue
        mean = merged(v[3], v[4], -np.asarray(x.added_sum, float), -x.added_count)
        if mean is None:
            e.gone.add(x.variant_id)
        else:
            v[3], v[4] = mean, v[4] - x.added_count
    t["commits"] = t["commits"].withColumn("status", F.when(F.col("id") == commit_id, "rolled_back").otherwise(F.col("status")))
    e.publish({"commits", "face_intervals", "video_metadata"} | e.changed())


def create_identity(store: Store, vec, count: int = 1, name: str | None = None) -> tuple[int, int]:
    e = _Edit(store)
    i = e.add_identity(name)
    v = e.add_variant(i, "Default", vec, count)
    e.publish(e.changed())
    return i, v[0]


def create_variant(store: Store, identity: int, name: str, vec, count: int = 1) -> int:
    e = _Edit(store)
    if e.t["identities"].where(F.col("id") == identity).isEmpty():
        raise CommitError(f"identity {identity} not found")
    v = e.add_variant(identity, name, vec, count)
    e.publish(e.changed())
    return v[0]


def update_variant(store: Store, variant: int, vec, count: int) -> None:
    """The weighted mean of what is stored and count faces of mean vec."""
    e = _Edit(store)
    v = e.by_id(variant)
    if v is None:
        raise CommitError(f"variant {variant} not found")
    v[3], v[4] = merged(v[3], v[4], np.asarray(vec, float) * count, count), v[4] + count
    e.publish(e.changed())


def set_variant_label(store: Store, variant: int, identity: str, name: str) -> None:
    """Moves a variant to the identity of that name, made if need be, and renames it. The old identity stays."""
    e = _Edit(store)
    v = e.by_id(variant)
    if v is None:
        raise CommitError(f"variant {variant} not found")
    row = e.t["identities"].where(F.lower("name") == identity.strip().lower()).first()
    goal = row.id if row else e.add_identity(identity.strip())
    other = e.variant(goal, name)
    if other is not None and other[0] != variant:
        raise CommitError(f"variant {name!r} exists")
    v[1], v[2] = goal, name
    e.publish(e.changed())


def rename(store: Store, table: str, ident: int, name: str) -> None:
    v = store.version()
    df = store.table(table, v)
    row = df.where(F.col("id") == ident).first()
    if row is None:
        raise CommitError(f"{table} {ident} not found")
    same = (F.lower("name") == name.lower()) & (F.col("id") != ident)
    if table == "variants":
        same &= F.col("identity_id").eqNullSafe(F.lit(row.identity_id))
    if not df.where(same).isEmpty():
        raise CommitError(f"name {name!r} exists")
    store.publish({table: df.withColumn("name", F.when(F.col("id") == ident, name).otherwise(F.col("name")))}, v)


def delete(store: Store, table: str, ident: int) -> bool:
    """Deletes an identity or a variant with all that refers to it. Returns whether a variant was its identity's last."""
    v = store.version()
    t = store.tables(v)
    row: Row | None = t[table].where(F.col("id") == ident).first()
    if row is None:
        raise CommitError(f"{table} {ident} not found")
    last = table == "variants" and t["variants"].where(F.col("identity_id") == row.identity_id).count() == 1
    t[table] = t[table].where(F.col("id") != ident)
    store.publish({n: t[n] for n in cascade(t, {table})}, v)
    return last


def replace_intervals(store: Store, video_id: str, path: str, intervals: DataFrame) -> None:
    """What a direct scan publishes: the video's metadata, and its intervals in place of older ones."""
    from pyspark.sql import Window

    v = store.version()
    t = store.tables(v)
    first = _next(t["face_intervals"])
    rows = intervals.withColumn("video_id", F.lit(video_id)).withColumn("id", (F.row_number().over(Window.partitionBy("video_id").orderBy("start_time", "end_time", "variant_id")) + (first - 1)).cast("long"))
    new = t["face_intervals"].where(F.col("video_id") != video_id).unionByName(rows.select("id", "video_id", "start_time", "end_time", "face_count", "variant_id"))
    meta = dml.upsert(t["video_metadata"], _frame(store, "video_metadata", [(video_id, path, _now())]), "id")
    store.publish({"face_intervals": new, "video_metadata": meta}, v)
