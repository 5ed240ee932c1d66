"""All shelves of a user behind one object."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.errors import GraphmillError, ShelfError
from graphmill.functions.content import MIME_TYPES, Content
from graphmill.plans.expressions import to_text
from graphmill.sources.embedding import embedder_for
from graphmill.sources.registry import DEFAULT, Registry
from graphmill.sources.store import Shelf


class Workspace:
    """Connects shelves and passes operations on to them.  A default shelf always exists."""

    def __init__(self, spark: SparkSession, home: str | os.PathLike | None = None, embedders: Callable[[Path], Any] = embedder_for):
        self.spark, self.home, self._embedders = spark, Path(home or Path.home() / ".graphmill"), embedders
        self.registry = Registry(self.home)
        self.open: dict[str, Shelf] = {}
        if DEFAULT not in self.registry.shelves:
            self.registry.register(DEFAULT, self.home / DEFAULT)
        for name, path in self.registry.shelves.items():
            try:
                self._open(path, name)
            except (OSError, GraphmillError) as error:
                if name == DEFAULT:
                    raise
                print(f"warning: shelf {name} could not be opened: {error}", file=sys.stderr)

    def _open(self, path: str | os.PathLike, name: str | None) -> Shelf:
        shelf = Shelf(self.spark, path, name, self._embedders(Path(path)))
        if shelf.name in self.open:
            raise ShelfError(f"shelf {shelf.name!r} is already connected")
        self.open[shelf.name] = shelf
        return shelf

    def connect(self, path: str | os.PathLike, name: str | None = None) -> str:
        shelf = self._open(path, name)
        self.registry.register(shelf.name, shelf.path)
        return shelf.name

    def disconnect(self, name: str) -> None:
        self.shelf(name)
        del self.open[name]
        self.registry.unregister(name)

    def shelf(self, name: str = DEFAULT) -> Shelf:
        if name not in self.open:
            raise ShelfError(f"shelf {name!r} is not connected")
        return self.open[name]

    def list(self) -> list[tuple[str, str, bool]]:
        """(name, path, connected) by name."""
        return [(n, p, n in self.open) for n, p in sorted(self.registry.shelves.items())]

    def query(self, shelf: str, expression: Any) -> DataFrame:
        return self.shelf(shelf).query(expression)

    def query_all(self, expression: Any) -> DataFrame:
        """The same query on every connected shelf, with the shelf's name: an extension."""
        parts = [s.query(expression).select(F.lit(n).alias("shelf"), "*") for n, s in sorted(self.open.items())]
        result = parts[0]
        for part in parts[1:]:
            result = result.unionByName(part)
        return result

    def store_file(self, shelf: str, source: str | os.PathLike, relative: str | None = None) -> str:
        """Archive a file with a knowledge row of its metadata and a statement that it is an archive."""
        target = self.shelf(shelf)
        relative = relative or Path(source).name
        target.store_archive(source, relative)
        extension = Path(relative).suffix.removeprefix(".").lower()
        mime = MIME_TYPES.get(extension, "application/octet-stream")
        kind = mime.split("/")[0]
        meta = to_text({"filename": relative, "size_bytes": os.path.getsize(source), "mime_type": mime})
        category = kind if kind in ("image", "video", "audio") else "file"
        target.create_knowledge(relative, Content(meta, "json", ["archive", category, extension], figures=[f"archive://{relative}"]))
        try:
            target.create_statement(relative, "is_a", "archive", Content(tags=["archive"]))
        except GraphmillError:
            pass
        return relative
