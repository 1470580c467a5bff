"""Files as rows: JPEG streams, raw frames, worker streams, and identities of videos."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIB = 1 << 20


def split_jpegs(data: bytes) -> list[bytes]:
    """Images between their start and end marks; what lies between images, and a last one without end, is dropped."""
    out, at = [], 0
    while (a := data.find(b"\xff\xd8", at)) >= 0 and (b := data.find(b"\xff\xd9", a + 2)) >= 0:
        out.append(data[a : b + 2])
        at = b + 2
    return out


def jpeg_frames(spark: SparkSession, path: str, nth: int = 1) -> DataFrame:
    """(video_id, frame_index, data): the images of MJPEG streams, one file a video, numbered by the sampled step."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for name, content in zip(p["path"], p["content"], strict=True):
                images = split_jpegs(content)
                yield pd.DataFrame({"video_id": [name] * len(images), "frame_index": [i * nth for i in range(len(images))], "data": images})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "video_id string, frame_index long, data binary")


def raw_frames(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """(video_id, frame_index, width, height, data): RGBA frames of fixed size; a short last one is dropped."""
    size = width * height * 4

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for name, content in zip(p["path"], p["content"], strict=True):
                n = len(content) // size
                yield pd.DataFrame({"video_id": [name] * n, "frame_index": range(n), "width": [width] * n, "height": [height] * n, "data": [content[i * size : (i + 1) * size] for i in range(n)]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "video_id string, frame_index long, width int, height int, data binary")


def video_id(name: str, size: int, read) -> str:
    """SHA-256 of the lower-case base name, the size, and the content: all of it up to 16 MiB, else evenly spread chunks
    of 1 MiB (8, or 16 from 8 GiB on), each after its place. read(offset, length) gives bytes."""
    h = hashlib.sha256(f"{name.rsplit('/', 1)[-1].lower()}|{size}|".encode())
    if size <= 16 * MIB:
        h.update(read(0, size))
    else:
        n = 16 if size >= 8 << 30 else 8
        for i in range(n):
            at = i * (size - MIB) // (n - 1)
            h.update(f"|chunk@{at}|".encode())
            h.update(read(at, MIB))
    return h.hexdigest()


def video_ids(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, video_id) of small files, in the JVM but for the hash of what is larger."""
    files = spark.read.format("binaryFile").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame({"path": p["path"], "size": p["length"], "video_id": [video_id(n, len(c), lambda a, k, c=c: c[a : a + k]) for n, c in zip(p["path"], p["content"], strict=True)]})

    return files.select("path", "length", "content").mapInPandas(run, "path string, size long, video_id string")


def with_fps(videos: DataFrame) -> DataFrame:
    """videos with fps: the average rate if it can be read and is positive, else the base rate."""
    from facetline.functions import exprs as X

    return videos.withColumn("fps", F.coalesce(X.fps(F.col("avg_frame_rate")), X.fps(F.col("r_frame_rate"))))


#: What a probe of a video's first stream gives.
PROBE = "struct<streams: array<struct<width: int, height: int, nb_frames: string, avg_frame_rate: string, r_frame_rate: string>>>"


def probed(videos: DataFrame) -> DataFrame:
    """videos with a probe's JSON in probe: instead, width, height, nb_frames and fps of the first stream. A number of
    frames that is missing, not a number or not positive is 0, which means unknown; sizes that are not positive are null,
    and so is all of a probe that can't be read or has no stream."""
    s = F.from_json(F.col("probe"), PROBE)["streams"]
    s = F.get(s, F.lit(0))
    frames = F.greatest(F.coalesce(s["nb_frames"].try_cast("long"), F.lit(0)), F.lit(0))
    size = {c: F.when(s[c] > 0, s[c]) for c in ("width", "height")}
    rates = {c: s[c] for c in ("avg_frame_rate", "r_frame_rate")}
    return with_fps(videos.withColumns({**size, "nb_frames": frames, **rates})).drop("probe", *rates)


class StreamError(ValueError):
    """A worker's own message, or a stream that breaks off."""


def decode_faces(data: bytes, dim: int = 512, most: int = 1 << 30, most_error: int = MIB) -> list[dict]:
    """Faces of one response of a captured worker stream: length, status, then records in big-endian order."""
    if len(data) < 5:
        raise StreamError("response is cut off")
    length, status = struct.unpack_from(">IB", data)
    if length > most or len(data) < 4 + length:
        raise StreamError("response is too long or cut off")
    at = 5
    if status == 1:
        (n,) = struct.unpack_from(">I", data, at)
        if n > most_error:
            raise StreamError("message is too long")
        raise StreamError(data[at + 4 : at + 4 + n].decode("utf-8", "replace"))
    (faces,) = struct.unpack_from(">I", data, at)
    at, out = at + 4, []
    try:
        for _ in range(faces):
            box = struct.unpack_from(">4i", data, at)
            vec = np.frombuffer(data, ">f4", dim, at + 16).astype(float)
            quality, n = struct.unpack_from(">fI", data, at + 16 + 4 * dim)
            at += 24 + 4 * dim
            if at + n > 4 + length:
                raise StreamError("response is cut off")
            out.append({"box": box, "vec": vec, "quality": quality, "thumb": data[at : at + n]})
            at += n
    except (struct.error, ValueError) as e:
        raise StreamError("response is cut off") from e
    return out


def encode_faces(faces: list[dict]) -> bytes:
    """The inverse, for fixtures and export."""
    body = struct.pack(">BI", 0, len(faces))
    for f in faces:
        body += struct.pack(">4i", *f["box"]) + np.asarray(f["vec"], ">f4").tobytes() + struct.pack(">fI", f["quality"], len(f["thumb"])) + f["thumb"]
    return struct.pack(">I", len(body)) + body
