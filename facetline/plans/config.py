"""Where the store is: an argument, else the environment, else a local .env file, else a default."""

from __future__ import annotations

import os
import re
import time
from pathlib import Path

from pyspark.sql import SparkSession

from facetline.store.snapshot import Store

VARIABLE, DEFAULT = "FACETLINE_STORE", "facetline-store"
LINE = re.compile(r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$")


def read_env(text: str) -> dict[str, str]:
    """Variables of a .env file: comments and blank lines are skipped, quotes around a value are taken off."""
    out = {}
    for line in text.splitlines():
        if not line.lstrip().startswith("#") and (m := LINE.match(line)):
            v = m[2]
            out[m[1]] = v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'" else v
    return out


def store_root(given: str | None = None, folder: str = ".") -> str:
    local = Path(folder) / ".env"
    return given or os.environ.get(VARIABLE) or (read_env(local.read_text()).get(VARIABLE) if local.is_file() else None) or DEFAULT


def open_store(spark: SparkSession, given: str | None = None, tries: int = 15, wait: float = 2.0) -> Store:
    """The store, tried a few times, as shared storage can come up after the job."""
    for left in range(tries, 0, -1):
        try:
            return Store(spark, store_root(given))
        except Exception:
            if left == 1:
                raise
            time.sleep(wait)
    raise ValueError("no tries")
