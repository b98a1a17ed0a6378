"""Numbered states of something kept on disk, for one writer at a time.

A state is a small JSON file that names the folders in force.  A new one is written under the next
number and appears by one rename; the one before stays until then, so a writer that dies at any point
leaves the last complete state and at worst some folders that no state names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.sql import SparkSession

_NAME = re.compile(r"state-(\d{8})\.json")


class Versions:
    """The states under ``root``, a folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        where, fs = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def _numbers(self) -> list[int]:
        return sorted(int(m.group(1)) for n in self._names(self.root) if (m := _NAME.fullmatch(n)))

    def load(self) -> dict | None:
        """The last complete state; None where nothing was ever written.

        Raises RuntimeError where there are folders but no complete state: going on from nothing would
        silently forget what they hold.
        """
        for number in reversed(self._numbers()):
            text = self.spark.read.text(f"{self.root}/state-{number:08}.json", wholetext=True).first()
            try:
                return json.loads(text[0])
            except (ValueError, TypeError):
                continue
        if self._names(self.root):
            raise RuntimeError(f"{self.root} holds data but no complete state")
        return None

    def store(self, state: dict) -> None:
        """Put a new state in force; the one before is kept beside it."""
        numbers = self._numbers()
        number = numbers[-1] + 1 if numbers else 0
        draft, fs = self._fs(f"{self.root}/draft-{number:08}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        final, _ = self._fs(f"{self.root}/state-{number:08}.json")
        if not fs.rename(draft, final):
            raise OSError(f"cannot write {final}")
        for old in numbers[:-1]:
            fs.delete(self._fs(f"{self.root}/state-{old:08}.json")[0], False)

    def sweep(self, folder: str, keep: Iterable[str]) -> None:
        """Delete what ``root/folder`` holds beyond ``keep``; call it once the state in force doesn't name it."""
        kept = set(keep)
        for name in self._names(f"{self.root}/{folder}"):
            if name not in kept and not name.startswith(("state-", "_")):
                where, fs = self._fs(f"{self.root}/{folder}/{name}")
                fs.delete(where, True)
