"""Detection as a table function: frames in, zero or more faces per frame out, by any detector that is handed in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from facetline.functions.constants import EMBEDDING_DIM

FULL = "video_id string, frame_index long, face_idx int, x1 int, y1 int, x2 int, y2 int, vec array<float>, quality double, thumb binary"
BOXES = "video_id string, frame_index long, face_idx int, x1 int, y1 int, x2 int, y2 int"


def detect(frames: DataFrame, load: Callable[[], Callable[[bytes], list[dict]]], mode: str = "full", dim: int = EMBEDDING_DIM) -> DataFrame:
    """Faces of frames (video_id, frame_index, data). load() makes the detector, once for each task; it maps an image to
    dicts of box, vec, quality and thumb. Mode "boxes" asks for boxes only, and no vectors are moved. A frame without
    faces is a row whose face_idx is null, as later steps need to know that it was there. Boxes less than a pixel wide
    or high, and in full mode vectors without a direction, are no faces; vectors of another length raise."""
    full = mode == "full"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = load()
        for p in batches:
            rows = []
            for video, index, data in zip(p["video_id"], p["frame_index"], p["data"], strict=True):
                faces = []
                for f in detector(data):
                    x1, y1, x2, y2 = map(int, f["box"])
                    if x2 - x1 < 1 or y2 - y1 < 1:
                        continue
                    if full:
                        vec = np.asarray(f["vec"], np.float32)
                        if len(vec) != dim:
                            raise ValueError(f"the detector gave {len(vec)} dimensions, not {dim}")
                        norm = float(np.sqrt((vec.astype(float) ** 2).sum()))
                        if norm <= 1e-6:
                            continue
                        faces.append((x1, y1, x2, y2, (vec / norm).tolist(), float(f["quality"]), f.get("thumb")))
                    else:
                        faces.append((x1, y1, x2, y2))
                rows += [(video, index, i, *f) for i, f in enumerate(faces)] or [(video, index, *[None] * (8 if full else 5))]
            names = [c.split()[0] for c in (FULL if full else BOXES).split(", ")]
            out = pd.DataFrame(rows, columns=names).astype({c: "Int32" for c in ("face_idx", "x1", "y1", "x2", "y2")})
            yield out.astype({c: object for c in names[7:] if c != "quality"})

    return frames.select("video_id", "frame_index", "data").mapInPandas(run, FULL if full else BOXES)
