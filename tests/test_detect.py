import numpy as np
import pytest

from facetline.operators import detect
from facetline.plans import config


def test_detect(spark):
    def load():  # inside, as workers do not import test modules
        return lambda data: [{"box": (0, 0, int(b), 4), "vec": [float(b), 0.0], "quality": 0.5, "thumb": b"t"} for b in data]

    frames = spark.createDataFrame([("v", 0, bytearray([3, 0, 5])), ("v", 1, bytearray())], "video_id string, frame_index long, data binary")
    got = sorted((r.frame_index, r.face_idx, r.x2, r.vec and np.round(r.vec, 3).tolist()) for r in detect.detect(frames, load, dim=2).where("face_idx is not null").collect())
    assert got == [(0, 0, 3, [1.0, 0.0]), (0, 1, 5, [1.0, 0.0])]
    boxes = detect.detect(frames, load, "boxes")
    assert "vec" not in boxes.columns and boxes.where("face_idx is null").count() == 1
    with pytest.raises(Exception, match="dimensions"):
        detect.detect(frames, load, dim=3).collect()


def test_config(tmp_path, monkeypatch):
    monkeypatch.delenv(config.VARIABLE, raising=False)
    assert config.store_root(folder=str(tmp_path)) == config.DEFAULT
    (tmp_path / ".env").write_text("# x\nexport FACETLINE_STORE='file'\n")
    assert config.store_root(folder=str(tmp_path)) == "file"
    monkeypatch.setenv(config.VARIABLE, "env")
    assert config.store_root(folder=str(tmp_path)) == "env" and config.store_root("arg") == "arg"
