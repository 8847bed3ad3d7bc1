"""Named option sets in a JSON file."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..schema import PRESETS


@dataclass
class Presets:
    """Save, update, load and delete; a missing or broken file is an empty list."""

    path: Path

    def load(self) -> list[dict]:
        try:
            found = json.loads(Path(self.path).read_text("utf-8"))
        except (OSError, ValueError):
            return []
        return found if isinstance(found, list) else []

    def _store(self, presets: list[dict]) -> None:
        Path(self.path).write_text(json.dumps(presets), "utf-8")

    def save(self, name: str, data: dict) -> dict:
        one = {"id": str(uuid.uuid4()), "name": name or timestamp(), "timestamp": int(time.time() * 1000), "data": data}
        self._store([*self.load(), one])
        return one

    def update(self, preset_id: str, data: dict) -> None:
        now = int(time.time() * 1000)
        self._store([p | {"data": data, "timestamp": now} if p["id"] == preset_id else p for p in self.load()])

    def delete(self, preset_id: str) -> None:
        self._store([p for p in self.load() if p["id"] != preset_id])

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(p["id"], p["name"], p["timestamp"], {k: str(v) for k, v in p["data"].items()}) for p in self.load()]
        return spark.createDataFrame(rows, PRESETS)


def timestamp(at: datetime | None = None) -> str:
    """As file names have it."""
    return (at or datetime.now()).strftime("%Y-%m-%d_%H-%M-%S")
