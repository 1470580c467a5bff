"""The tracker on a stream: the batch kernel, its state carried from one micro-batch to the next."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, StructField, StructType

from facetline.kernels import tracker
from facetline.operators.video import TRACKS, tracks_frame


class TrackProcessor(StatefulProcessor):
    """Per video: frames that came early wait until those before them are there; a row with is_last ends the video.

    A closed track is put out as soon as its grace period is over; a video that ends while frames are missing raises, so
    that its batch is not committed.
    """

    def __init__(self, options: tracker.Options):
        self.o = options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", StructType([StructField("v", BinaryType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        video = str(key[0])
        t, waiting, due, last, done = pickle.loads(self.state.get()[0]) if self.state.exists() else (tracker.Tracker(self.o), {}, 0, None, 0)
        for p in rows:
            for f, g in p.sort_values(["frame_index", "face_idx"], kind="stable").groupby("frame_index"):
                faces = g[g["face_idx"].notna()]
                own = waiting.setdefault(int(f), [])
                own += [(int(i), tracker.Face(np.asarray(v, float), float(q), int(k))) for i, v, q, k in zip(faces["face_idx"], faces["vec"], faces["quality"], faces["known"], strict=True)]
                if g["is_last"].any():
                    last = int(f)
        closed = []
        while due in waiting:
            closed += t.step(due, [x for _, x in sorted(waiting.pop(due), key=lambda x: x[0])])
            due += self.o.nth
        if last is not None:
            if due <= last:
                raise ValueError(f"frame {due} of {video} is missing")
            closed += t.finish()
            self.state.clear()
        out = tracks_frame(t, closed, video, done + 1)
        if last is None:
            self.state.update((pickle.dumps((t, waiting, due, last, done + len(out))),))
        if len(out):
            yield out

    def close(self) -> None:
        pass


def track_stream(detections: DataFrame, options: tracker.Options | None = None) -> DataFrame:
    """TRACKS of a stream of detections (video_id, frame_index, face_idx, vec, quality, known, is_last)."""
    return detections.groupBy("video_id").transformWithStateInPandas(TrackProcessor(options or tracker.Options()), outputStructType=TRACKS, outputMode="Append", timeMode="None")


def publish(tracks: DataFrame, path: str, checkpoint: str):
    """Each batch replaces its own folder, so that a batch that runs twice is there once. Returns the started query."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return tracks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
