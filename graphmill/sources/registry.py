"""Which shelves are known, and where they lie: a small JSON file."""

from __future__ import annotations

import json
import os
from pathlib import Path

DEFAULT = "default"


class Registry:
    """Names and folders of shelves, kept in ``shelves.json`` below ``home``."""

    def __init__(self, home: str | os.PathLike):
        self.home = Path(home)
        self.file = self.home / "shelves.json"
        self.shelves: dict[str, str] = json.loads(self.file.read_text()) if self.file.exists() else {}

    def _save(self) -> None:
        self.home.mkdir(parents=True, exist_ok=True)
        fresh = self.file.with_suffix(".tmp")
        fresh.write_text(json.dumps(self.shelves, indent=1, sort_keys=True))
        os.replace(fresh, self.file)

    def register(self, name: str, path: str | os.PathLike) -> None:
        self.shelves[name] = str(path)
        self._save()

    def unregister(self, name: str) -> None:
        if self.shelves.pop(name, None) is not None:
            self._save()
