"""Which boxes of each frame to hide: matching to targets, instance tracking, linger and the paranoid modes."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from facetline.functions.constants import BOX_SCALE, LINGER_SECONDS, MATCH_THRESHOLD
from facetline.kernels.vectors import nearest

Box = tuple[int, int, int, int]


def clip(b: Box, width: int, height: int) -> Box:
    return max(0, min(b[0], width)), max(0, min(b[1], height)), max(0, min(b[2], width)), max(0, min(b[3], height))


def scaled(b: Box, scale: float, width: int, height: int) -> Box:
    """The box grown about its centre, then clipped; 1 clips only, 0 or less is the default."""
    scale = scale if scale > 0 else BOX_SCALE
    if scale == 1:
        return clip(b, width, height)
    half = [max(1.0, np.floor((b[i + 2] - b[i]) * scale + 0.5)) / 2 for i in (0, 1)]
    mid = [(b[i] + b[i + 2]) / 2 for i in (0, 1)]
    return clip((int(np.floor(mid[0] - half[0])), int(np.floor(mid[1] - half[1])), int(np.ceil(mid[0] + half[0])), int(np.ceil(mid[1] + half[1]))), width, height)


@dataclass
class Options:
    mode: str = "targeted"  # or blur-all
    threshold: float = MATCH_THRESHOLD
    linger: float = LINGER_SECONDS
    fps: float = 25.0
    paranoid: bool = False
    strict: bool = False
    scale: float = BOX_SCALE

    @property
    def linger_frames(self) -> int:
        return int(self.linger * self.fps)


@dataclass
class Instance:
    identity: int
    seen: int
    box: Box


@dataclass
class Redactor:
    """State of one video: the instances of target identities seen lately. step() returns (box, reason) in the order in
    which they are painted."""

    options: Options
    targets: list[tuple[int, np.ndarray]] = field(default_factory=list)  # (identity, vec)
    instances: list[Instance] = field(default_factory=list)

    def step(self, frame: int, faces: list[tuple[Box, np.ndarray | None]], width: int, height: int) -> list[tuple[Box, str]]:
        o = self.options
        fit = lambda b: scaled(b, o.scale, width, height)
        if o.mode == "blur-all":
            return [(fit(b), "blur_all") for b, _ in faces]
        vecs = [v for _, v in self.targets]
        who = [self.targets[i][0] if (i := nearest(v, vecs, o.threshold)) >= 0 else None for _, v in faces]
        for identity in dict.fromkeys(w for w in who if w is not None):
            self._follow(identity, [b for (b, _), w in zip(faces, who, strict=True) if w == identity], frame)
        unseen = [t for t in self.instances if t.seen != frame and frame - t.seen <= o.linger_frames]
        if o.strict:
            alarm = bool({i for i, _ in self.targets} - set(who))
        else:
            alarm = o.paranoid and bool(unseen)
        out = [(fit(b), "match" if w is not None else "paranoid") for (b, _), w in zip(faces, who, strict=True) if alarm or w is not None]
        out += [(fit(t.box), "linger") for t in unseen]
        self.instances = [t for t in self.instances if frame - t.seen <= o.linger_frames]
        return out

    def _follow(self, identity: int, boxes: list[Box], frame: int) -> None:
        """Each box takes the nearest instance of its identity that no box of this frame has taken, or is a new one."""
        free = [t for t in self.instances if t.identity == identity]
        for b in boxes:
            if free:
                t = min(free, key=lambda t: (b[0] + b[2] - t.box[0] - t.box[2]) ** 2 + (b[1] + b[3] - t.box[1] - t.box[3]) ** 2)
                free.remove(t)
                t.seen, t.box = frame, b
            else:
                self.instances.append(Instance(identity, frame, b))
