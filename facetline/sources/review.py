"""Review documents: what people edit as YAML, what is kept beside it as JSON, and what a commit is made of."""

from __future__ import annotations

import hashlib
import json
import re
import secrets
from collections.abc import Callable
from typing import Any

from facetline.functions.constants import EMBEDDING_DIM

#: Fields by level; anything else in a document is an error. Fixed values.
TOP = {"review_id", "video_id", "input_path", "raw_tracks", "unresolved_tracks", "potential_identities"}
TRACK = {"start_time", "end_time", "nearest_candidates", "confidence", "suggested_identity", "suggested_variant", "suggested_action", "artifact_dir"}
GROUP = {"id", "tracks", "identity", "variant", "action"}
CANDIDATE = {"identity", "variant", "distance"}
INTERNAL = {"internal_vector", "internal_count", "fingerprint"}
ACTIONS = {"merge", "new_identity", "new_variant", "discard"}
REF = re.compile(r"[1-9][0-9]*")
LABEL = re.compile(r"(?i)^identity \d+$")

GUIDE = """# Edit potential_identities: each has tracks ("3" or "3-7"), an action, an identity and a variant.
# Actions: merge (into identity and variant), new_identity, new_variant (of identity), discard. A blank action must be filled in.
# Move every track of unresolved_tracks to a group. Do not edit raw_tracks.
"""


class ReviewError(ValueError):
    pass


def new_review_id() -> str:
    return secrets.token_hex(6)


def _only(row: Any, fields: set[str], where: str) -> dict:
    if not isinstance(row, dict):
        raise ReviewError(f"{where} is not a mapping")
    if inside := INTERNAL & set(row):
        raise ReviewError(f"{where} holds internal data: {', '.join(sorted(inside))}")
    if more := set(row) - fields:
        raise ReviewError(f"{where} has unknown fields: {', '.join(sorted(map(str, more)))}")
    return row


def read(text: str) -> dict:
    """A document, with fields checked at every level."""
    import yaml

    doc = _only(yaml.safe_load(text), TOP, "review")
    tracks, seen = {}, set()
    for key, row in (doc.get("raw_tracks") or {}).items():
        row = _only(row, TRACK, f"track {key}")
        for c in row.get("nearest_candidates") or []:
            _only(c, CANDIDATE, f"candidate of track {key}")
        if str(key) in tracks:
            raise ReviewError(f"track {key} is there twice")
        tracks[str(key)] = row
    groups = []
    for g in doc.get("potential_identities") or []:
        g = _only(g, GROUP, "group")
        if g.get("id") in seen:
            raise ReviewError(f"group {g.get('id')} is there twice")
        seen.add(g.get("id"))
        groups.append(g | {"tracks": [str(t) for t in g.get("tracks") or []]})
    return {**doc, "raw_tracks": tracks, "unresolved_tracks": [str(t) for t in doc.get("unresolved_tracks") or []], "potential_identities": groups}


def write(doc: dict) -> str:
    """YAML of a document, after a few lines of guidance."""
    import yaml

    return GUIDE + yaml.safe_dump(doc, sort_keys=False, allow_unicode=True, indent=4)


def expand_refs(refs: list[str], known: set[str]) -> list[str]:
    """Track ids of references such as "3" and "3-7". Ranges rise, and each of their ids must exist; the ids that there
    are bound the work, however wide a range is."""
    out: list[str] = []
    ids = sorted(int(k) for k in known if REF.fullmatch(k))
    for ref in (r.strip() for r in refs):
        a, dash, b = (x.strip() for x in ref.partition("-"))
        if not REF.fullmatch(a) or (dash and not REF.fullmatch(b)):
            raise ReviewError(f"bad track reference {ref!r}")
        lo, hi = int(a), int(b or a)
        if hi < lo:
            raise ReviewError(f"range {ref!r} falls")
        inside = [i for i in ids if lo <= i <= hi]
        if len(inside) != hi - lo + 1:
            gap = next(i for i in range(lo, hi + 1) if i not in set(inside)) if inside[:1] == [lo] else lo
            raise ReviewError(f"track {gap} of {ref!r} does not exist")
        out += [str(i) for i in inside]
    return out


def expand(doc: dict) -> list[dict]:
    """One row per track: its group, its place in it (0 seeds), and the group's trimmed action, identity and variant.
    Every raw track must be in exactly one group, and none may be unresolved any more."""
    known, rows, owner = set(doc["raw_tracks"]), [], {}
    for g in doc["potential_identities"]:
        for place, t in enumerate(expand_refs(g["tracks"], known)):
            if t in owner:
                raise ReviewError(f"track {t} is in groups {owner[t]} and {g.get('id')}")
            owner[t] = g.get("id")
            rows.append({"track_id": t, "group": g.get("id"), "place": place, **{k: str(g.get(k) or "").strip() for k in ("action", "identity", "variant")}})
    left = sorted(known - set(owner), key=lambda x: (len(x), x))
    if left:
        still = [t for t in left if t in set(doc["unresolved_tracks"])]
        raise ReviewError(f"unresolved tracks must be moved to a group: {', '.join(still)}" if still else f"tracks are in no group: {', '.join(left)}")
    if moved := [t for t in doc["unresolved_tracks"] if t not in known]:
        raise ReviewError(f"unresolved tracks do not exist: {', '.join(moved)}")
    return rows


def fingerprint(key: str, track: dict) -> str:
    """SHA-256 of what a reviewer must not edit, as canonical JSON."""
    rows = [{k: c.get(k) for k in ("identity", "variant", "distance")} for c in track.get("nearest_candidates") or []]
    body = {"key": key, "start_time": float(track["start_time"]), "end_time": float(track["end_time"]), "nearest_candidates": rows, "confidence": float(track.get("confidence") or 0)}
    return hashlib.sha256(json.dumps(body, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def split(doc: dict, vectors: dict[str, tuple[list[float], int]]) -> tuple[str, str]:
    """The YAML to edit and the JSON beside it, with vectors, counts and fingerprints."""
    own = {k: {"fingerprint": fingerprint(k, t), "internal_vector": list(map(float, vectors[k][0])), "internal_count": int(vectors[k][1])} for k, t in doc["raw_tracks"].items()}
    meta = {k: doc[k] for k in ("review_id", "video_id", "input_path")}
    return write(doc), json.dumps({**meta, "tracks": own}, indent=2)


def sidecar_path(path: str) -> str:
    return re.sub(r"\.ya?ml$", "", path) + ".data.json"


def hydrate(doc: dict, sidecar: str) -> list[dict]:
    """expand(), with vector, count and times; the JSON must be of this review, with these tracks, and none edited."""
    side = json.loads(sidecar)
    if blank := [k for k in ("review_id", "video_id", "input_path") if not doc.get(k)]:
        raise ReviewError(f"the review lacks {', '.join(blank)}")
    for k in ("review_id", "video_id", "input_path"):
        if side.get(k) != doc.get(k):
            raise ReviewError(f"{k} of the data file differs")
    rows, data = expand(doc), side.get("tracks") or {}
    if odd := set(data) ^ set(doc["raw_tracks"]):
        raise ReviewError(f"tracks are in one of review and data file only: {', '.join(sorted(odd))}")
    for r in rows:
        raw, own = doc["raw_tracks"][r["track_id"]], data[r["track_id"]]
        if own["fingerprint"] != fingerprint(r["track_id"], raw):
            raise ReviewError(f"track {r['track_id']} was edited")
        r |= {"vec": own["internal_vector"], "count": own["internal_count"], "start_time": float(raw["start_time"]), "end_time": float(raw["end_time"])}
    return rows


def validate(r: dict, dim: int = EMBEDDING_DIM, exists: Callable[[int], bool] = lambda _: True) -> None:
    """exists: whether there is an identity of this number; a new identity's name must not be the label of one."""
    who = f"track {r['track_id']}"
    if r["action"] == "":
        raise ReviewError(f"{who} still needs an action")
    if r["action"] not in ACTIONS:
        raise ReviewError(f"{who} has unknown action {r['action']!r}")
    if r["action"] == "discard":
        return
    if len(r["vec"]) != dim:
        raise ReviewError(f"{who} has a vector of {len(r['vec'])}, not {dim}")
    if r["count"] <= 0 or r["start_time"] < 0 or r["end_time"] < r["start_time"]:
        raise ReviewError(f"{who} has no faces, or times that are negative or fall")
    if r["action"] in ("merge", "new_variant") and not r["identity"]:
        raise ReviewError(f"{who} needs an identity")
    if r["action"] == "new_variant" and not r["variant"]:
        raise ReviewError(f"{who} needs a variant")
    if r["action"] == "new_identity" and (m := LABEL.match(r["identity"])) and exists(int(re.search(r"\d+", m[0])[0])):
        raise ReviewError(f"{who}: {r['identity']!r} is a system label")


def prepare(rows: list[dict], dim: int = EMBEDDING_DIM, exists: Callable[[int], bool] = lambda _: True) -> list[dict]:
    """The actions of a commit: a group that creates something seeds it with its first track and merges the rest into
    that one. New identities' names must differ, whatever their case."""
    seeds: dict[Any, str] = {}
    names: set[str] = set()
    out = []
    for r in rows:
        validate(r, dim, exists)
        a = dict(r)
        if r["action"] in ("new_identity", "new_variant"):
            if r["group"] in seeds:
                a |= {"action": "merge", "target_track": seeds[r["group"]]}
            else:
                seeds[r["group"]] = r["track_id"]
                name = r["identity"].lower()
                if r["action"] == "new_identity" and name:
                    if name in names:
                        raise ReviewError(f"identity {r['identity']!r} is created twice")
                    names.add(name)
        out.append(a)
    return out
