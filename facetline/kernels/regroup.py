"""Grouping a video's tracks into potential identities: a greedy pass, then a bounded refinement."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from facetline.functions.constants import AMBIGUITY_MARGIN, MOVE_MARGIN, REFINEMENT_ROUNDS, REGROUP_THRESHOLD, STRONG_THRESHOLD
from facetline.kernels.vectors import distance

INF = float("inf")


@dataclass
class Item:
    ident: int
    start: float
    end: float
    vec: np.ndarray
    count: int = 1

    @property
    def order(self) -> tuple[float, int]:
        return self.start, self.ident

    @property
    def weight(self) -> float:
        return float(self.count if self.count > 0 else 1)


@dataclass(frozen=True)
class Link:
    status: str
    best: int | None = None
    best_score: float | None = None
    second: int | None = None
    second_score: float | None = None
    blocked: int | None = None
    blocked_track: int | None = None


@dataclass(frozen=True)
class Candidate:
    cluster: int
    score: float
    member: float
    centroid: float
    overlap: int | None


@dataclass
class Cluster:
    ident: int
    members: dict[int, Item] = field(default_factory=dict)
    links: dict[int, Link] = field(default_factory=dict)

    def centroid(self) -> tuple[np.ndarray | None, float]:
        """Weighted mean and total weight; members of another length than the first are skipped."""
        rows = [m for m in self.members.values() if m.vec is not None and len(m.vec)]
        rows = [m for m in rows if len(m.vec) == len(rows[0].vec)]
        if not rows:
            return None, 0.0
        total = sum(m.weight for m in rows)
        return sum(np.asarray(m.vec, float) * m.weight for m in rows) / total, total

    def put(self, item: Item, link: Link) -> None:
        self.members[item.ident], self.links[item.ident] = item, link
        self.members = dict(sorted(self.members.items(), key=lambda kv: kv[1].order))

    def without(self, ident: int) -> Cluster:
        return Cluster(self.ident, {k: v for k, v in self.members.items() if k != ident}, {k: v for k, v in self.links.items() if k != ident})


def _three(x: float) -> float:
    return float(np.floor(x * 1000 + 0.5) / 1000)


def candidates(item: Item, clusters: list[Cluster]) -> tuple[list[Candidate], list[Candidate]]:
    """Eligible and blocked clusters, each by score, best member and id. A cluster is blocked by its first member whose
    span overlaps the item's, and eligible if centroid and best member are both near enough."""
    eligible, blocked = [], []
    for c in clusters:
        mean, _ = c.centroid()
        has = item.vec is not None and len(item.vec)
        d = distance(item.vec, mean) if has and mean is not None else INF
        m = min((distance(item.vec, x.vec) if has and x.vec is not None and len(x.vec) else INF for x in c.members.values()), default=INF)
        over = next((x.ident for x in c.members.values() if item.start < x.end and x.start < item.end), None)
        cand = Candidate(c.ident, max(d, m), m, d, over)
        if over is not None:
            blocked.append(cand)
        elif d <= REGROUP_THRESHOLD and m <= REGROUP_THRESHOLD:
            eligible.append(cand)
    by = lambda x: (x.score, x.member, x.cluster)
    return sorted(eligible, key=by), sorted(blocked, key=by)


def link(item: Item, clusters: list[Cluster]) -> tuple[Link, list[Candidate]]:
    eligible, blocked = candidates(item, clusters)
    if not eligible:
        b = blocked[0] if blocked and blocked[0].score <= REGROUP_THRESHOLD else None
        return Link("NEW", blocked=b and b.cluster, blocked_track=b and b.overlap), eligible
    one, two = eligible[0], eligible[1] if len(eligible) > 1 else None
    if two and abs(two.score - one.score) < AMBIGUITY_MARGIN:
        status = "AMBIGUOUS"
    else:
        status = "STRONG" if one.score <= STRONG_THRESHOLD else "POSSIBLE"
    return Link(status, one.cluster, _three(one.score), two and two.cluster, two and _three(two.score)), eligible


@dataclass
class Grouping:
    clusters: list[Cluster]
    unresolved: dict[int, tuple[Item, Link]]

    def renumbered(self) -> list[tuple[int, Cluster]]:
        return list(enumerate(self.clusters, 1))

    def _signature(self) -> tuple:
        return tuple((c.ident, tuple(sorted(c.members))) for c in self.clusters), tuple(sorted(self.unresolved))

    def _place(self, cluster: int, item: Item, how: Link) -> None:
        """Into the cluster of that id, which is made again if it is gone."""
        c = next((c for c in self.clusters if c.ident == cluster), None)
        if c is None:
            c = Cluster(cluster)
            self.clusters.append(c)
            self.clusters.sort(key=lambda x: x.ident)
        c.put(item, how)

    def _drop_empty(self) -> None:
        self.clusters = [c for c in self.clusters if c.members]


def greedy(items: list[Item]) -> Grouping:
    """In order of time: join a clear best, set aside what two could take, else begin a new cluster."""
    g, n = Grouping([], {}), 0
    for item in sorted(items, key=lambda x: x.order):
        how, _ = link(item, g.clusters)
        if how.status in ("STRONG", "POSSIBLE"):
            g._place(how.best, item, how)
        elif how.status == "AMBIGUOUS":
            g.unresolved[item.ident] = (item, how)
        else:
            n += 1
            g._place(n, item, how)
    return g


def _review_possible(g: Grouping) -> bool:
    """Look again at POSSIBLE members, each against the clusters as they are without it; then act on all at once."""
    plan = []
    for c in g.clusters:
        for ident, how in c.links.items():
            if how.status == "POSSIBLE":
                item = c.members[ident]
                frozen = [x for x in (k.without(ident) if k is c else k for k in g.clusters) if x.members]
                new, eligible = link(item, frozen)
                own = next((e for e in eligible if e.cluster == c.ident), None)
                if new.status not in ("STRONG", "POSSIBLE"):
                    goal = None
                elif new.best == c.ident or (own and eligible[0].score + MOVE_MARGIN >= own.score):
                    goal = c.ident
                else:
                    goal = new.best
                plan.append((ident, c.ident, goal, item, new))
    changed = False
    for ident, here, goal, item, new in sorted(plan, key=lambda p: p[0]):
        home = next(c for c in g.clusters if c.ident == here)
        if goal == here:
            home.links[ident] = new
            continue
        changed = True
        home.members.pop(ident)
        home.links.pop(ident)
        if goal is None:
            g.unresolved[ident] = (item, new)
        else:
            g._place(goal, item, new)
    g._drop_empty()
    return changed


def _review_unresolved(g: Grouping, strict_overlap: bool) -> bool:
    """Attach what has a clear best by now, all against the same clusters."""
    frozen = [Cluster(c.ident, dict(c.members), dict(c.links)) for c in g.clusters]
    changed = False
    for ident, (item, _) in sorted(g.unresolved.items(), key=lambda kv: kv[1][0].order):
        new, _ = link(item, g.clusters if strict_overlap else frozen)
        if new.status in ("STRONG", "POSSIBLE"):
            del g.unresolved[ident]
            g._place(new.best, item, new)
            changed = True
        else:
            g.unresolved[ident] = (item, new)
    g._drop_empty()
    return changed


def regroup(items: list[Item], rounds: int = REFINEMENT_ROUNDS, strict_overlap: bool = False) -> Grouping:
    """Greedy pass and refinement, until nothing changes, an assignment comes back, or the rounds are over.

    With strict_overlap, tracks attached in one round see each other, so that no two in a cluster overlap.
    """
    g = greedy(items)
    seen = {g._signature()}
    for _ in range(rounds):
        changed = _review_possible(g)
        changed |= _review_unresolved(g, strict_overlap)
        if not changed or g._signature() in seen:
            break
        seen.add(g._signature())
    return g


def report(g: Grouping) -> str:
    """A text for reviewers: each group's tracks, spans and links."""
    lines = []
    for n, c in g.renumbered():
        lines.append(f"Potential identity {n}: {len(c.members)} track(s)")
        for ident, m in c.members.items():
            how = c.links[ident]
            near = f", score {how.best_score:.3f}" if how.best_score is not None else ""
            lines.append(f"  track {ident}  {m.start:.2f}-{m.end:.2f} s  {how.status}{near}")
    if g.unresolved:
        lines.append("Unresolved: " + ", ".join(str(i) for i in sorted(g.unresolved)))
    return "\n".join(lines)
