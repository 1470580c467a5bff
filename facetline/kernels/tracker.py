"""Folding a video's ordered frames of faces into tracks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from facetline.functions.constants import BLIP_SECONDS, GRACE_SECONDS, MATCH_THRESHOLD, SAMPLE_DELTA, SAMPLE_FLOOR, TOP_FRAMES
from facetline.kernels.vectors import distances, nearest


@dataclass
class Face:
    vec: np.ndarray
    quality: float
    known: int = -1  # the closest variant below the threshold, looked up beforehand


@dataclass
class Track:
    ident: int  # a variant's id, or -1, -2, ... while pending
    start: int
    last: int
    mean: np.ndarray
    count: int = 0
    best: tuple[float, int] = (0.0, 0)
    lowest: tuple[float, int] = (0.0, 0)
    final: tuple[float, int] = (0.0, 0)
    top: list = field(default_factory=list)  # (quality, frame, vec)
    samples: list = field(default_factory=list)  # (frame, quality)

    @classmethod
    def open(cls, ident: int, frame: int, face: Face) -> Track:
        t = cls(ident, frame, frame, np.asarray(face.vec, float), 1)
        t.best = t.lowest = t.final = (face.quality, frame)
        t.top = [(face.quality, frame, t.mean)]
        t.samples = [(frame, face.quality)]
        return t

    def add(self, frame: int, face: Face) -> None:
        vec, q = np.asarray(face.vec, float), face.quality
        self.last = frame
        self.mean = (self.mean * self.count + vec) / (self.count + 1)
        self.count += 1
        self.final = (q, frame)
        if q > self.best[0]:
            self.best = (q, frame)
        if q < self.lowest[0]:
            self.lowest = (q, frame)
        if len(self.top) < TOP_FRAMES:
            self.top.append((q, frame, vec))
        else:
            i = min(range(len(self.top)), key=lambda k: self.top[k][0])
            if q > self.top[i][0]:
                self.top[i] = (q, frame, vec)
        kept = self.samples[-1][1]
        if kept > SAMPLE_FLOOR and abs(q - kept) / kept >= SAMPLE_DELTA:
            self.samples.append((frame, q))

    def representative(self) -> int:
        """The frame, of the best ones, whose face is nearest to the mean."""
        i = nearest(self.mean, [v for _, _, v in self.top], 2.0)
        return self.top[max(i, 0)][1]


@dataclass
class Options:
    threshold: float = MATCH_THRESHOLD
    grace: float = GRACE_SECONDS
    blip: float = BLIP_SECONDS
    fps: float = 25.0
    nth: int = 1

    @property
    def max_gap(self) -> int:
        return max(1, int(self.grace * self.fps))


class Tracker:
    """State of one video. step() takes frames in order and returns the tracks that it closes; finish() closes the rest.

    lookup: for direct scans, where tracks found earlier in the video become variants; by default Face.known is used.
    """

    def __init__(self, options: Options, lookup: Callable[[np.ndarray], int] | None = None):
        self.o, self.open, self.pending, self.faces = options, [], 0, 0
        self.lookup = lookup

    def step(self, frame: int, faces: list[Face]) -> list[Track]:
        closed = [t for t in self.open if frame - t.last > self.o.max_gap]
        self.open = [t for t in self.open if frame - t.last <= self.o.max_gap]
        taken = {t.ident for t in self.open}
        self.faces += len(faces)
        # every face proposes to one track; of a track's proposals the nearest wins, the earliest on ties
        wants: dict[int, list[tuple[float, int]]] = {}
        means = [t.mean for t in self.open]
        for i, f in enumerate(faces):
            j = nearest(f.vec, means, self.o.threshold)
            if j >= 0:
                wants.setdefault(j, []).append((float(distances(f.vec, [means[j]])[0]), i))
        won = {min(w)[1]: j for j, w in wants.items()}
        lost = {i for w in wants.values() for _, i in w} - set(won)
        for i, f in enumerate(faces):
            if i in won:
                self.open[won[i]].add(frame, f)
                continue
            known = -1 if i in lost else (self.lookup(f.vec) if self.lookup else f.known)
            if known < 0 or known in taken:
                self.pending += 1
                known = -self.pending
            taken.add(known)
            self.open.append(Track.open(known, frame, f))
        return closed

    def finish(self) -> list[Track]:
        closed, self.open = self.open, []
        return closed

    def span(self, t: Track) -> tuple[float, float] | None:
        """Seconds of a track, or null if it is a blip."""
        s, e = t.start / self.o.fps, (t.last + self.o.nth) / self.o.fps
        return None if e - s < self.o.blip else (s, e)


def check_frames(frames: list[int], nth: int) -> None:
    """A missing frame is an error: nothing may be made of a video that was read in part."""
    for a, b in zip(frames, frames[1:], strict=False):
        if b != a + nth:
            raise ValueError(f"frame {a + nth} is missing")
