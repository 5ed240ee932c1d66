"""Content JSON, triple keys and pattern matching."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphmill.errors import ValidationError

#: LIKE without an escape: this character is taken to occur in no pattern.
_NO_ESCAPE = "\u0001"
FORMATS = ("markdown", "json", "plain")
ARCHIVE = "archive://"


def like(column: Column, pattern: str) -> Column:
    """SQL LIKE in which a backslash is an ordinary character."""
    return F.like(column, F.lit(pattern), F.lit(_NO_ESCAPE))


def _csv_field(value: str) -> str:
    return '"' + value.replace('"', '""') + '"' if any(c in value for c in ',"\n') else value


def triple_key(subject: str, predicate: str, obj: str) -> str:
    """The key of a statement: its three parts as one CSV record."""
    return ",".join(map(_csv_field, (subject, predicate, obj)))


def split_triple(key: str) -> tuple[str, str, str] | None:
    """The parts of a key, or None where it has not three fields."""
    parts, current, quoted, i = [], [], False, 0
    while i < len(key):
        c = key[i]
        if quoted:
            if c == '"' and key[i + 1 : i + 2] == '"':
                current.append('"')
                i += 1
            elif c == '"':
                quoted = False
            else:
                current.append(c)
        elif c == '"':
            quoted = True
        elif c == ",":
            parts.append("".join(current))
            current = []
        else:
            current.append(c)
        i += 1
    parts.append("".join(current))
    return tuple(parts) if len(parts) == 3 else None


def triple_column(subject: Column, predicate: Column, obj: Column) -> Column:
    """:func:`triple_key` over columns."""
    fields = [F.when(c.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in (subject, predicate, obj)]
    return F.concat(fields[0], F.lit(","), fields[1], F.lit(","), fields[2])


def content_column(data: Column, tags: Column | None = None, format: Column | str = "markdown", scopes: Column | None = None) -> Column:
    """Content JSON of columns, nulls written out."""
    none = F.lit(None)
    parts = {
        "format": F.lit(format) if isinstance(format, str) else format,
        "data": data,
        "tags": tags if tags is not None else F.array().cast("array<string>"),
        "synonyms": none.cast("array<string>"),
        "figures": none.cast("array<string>"),
        "scopes": scopes if scopes is not None else none.cast("array<string>"),
    }
    return F.to_json(F.struct(*[c.alias(n) for n, c in parts.items()]), {"ignoreNullFields": "false"})


@dataclass
class Content:
    """What a row holds besides its key."""

    data: str = ""
    format: str = "markdown"
    tags: list[str] = field(default_factory=list)
    synonyms: list[str] | dict[str, list[str]] | None = None
    figures: list[str] | None = None
    scopes: list[str] | None = None

    def __post_init__(self) -> None:
        if self.format not in FORMATS:
            raise ValidationError(f"format must be one of {', '.join(FORMATS)}")
        self.figures, self.scopes = self.figures or None, self.scopes or None

    def to_json(self) -> str:
        parts = {n: getattr(self, n) for n in ("format", "data", "tags", "synonyms", "figures", "scopes")}
        return json.dumps(parts, separators=(",", ":"), ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Content:
        """Parse content strictly: ``tags`` is required, unknown keys vanish."""
        try:
            raw = json.loads(text)
            kept = {n: raw[n] for n in ("format", "data", "tags", "synonyms", "figures", "scopes") if n in raw}
            if not isinstance(kept["tags"], list):
                raise ValidationError("tags must be a list")
        except (ValueError, TypeError, KeyError) as error:
            raise ValidationError(f"malformed content: {error!r}") from None
        return cls(**kept)

    def embedding_text(self, key: str) -> str:
        return "\n".join(([", ".join(self.tags)] if self.tags else []) + [key, self.data])


def archive_path(figure: str) -> str | None:
    """The path behind ``archive://``; None for other figures."""
    return figure.removeprefix(ARCHIVE) if figure.startswith(ARCHIVE) else None


def archive_column(figure: Column) -> Column:
    """:func:`archive_path` over a column."""
    return F.when(F.startswith(figure, F.lit(ARCHIVE)), F.substring(figure, F.lit(len(ARCHIVE) + 1), F.length(figure)))


_STRINGS = "array<string>"


def tags(content: Column) -> Column:
    return F.from_json(F.get_json_object(content, "$.tags"), _STRINGS)


def synonyms(content: Column) -> Column:
    """Synonyms of either shape as one array, in the order of the map's keys."""
    text = F.get_json_object(content, "$.synonyms")
    listed = F.from_json(text, _STRINGS)
    mapped = F.from_json(text, "map<string,array<string>>")
    in_order = F.flatten(F.transform(F.array_sort(F.map_keys(mapped)), lambda k: mapped[k]))
    return F.when(F.startswith(text, F.lit("[")), listed).when(F.startswith(text, F.lit("{")), in_order)


def joined(items: Column, separator: str = " ") -> Column:
    return F.coalesce(F.array_join(items, separator), F.lit(""))


def embedding_text(key: Column, content: Column) -> Column:
    """Tags, key and data, one to a line; without tags their line is left out.  Null where content has no data."""
    listed = tags(content)
    return F.concat_ws("\n", F.when(F.size(listed) > 0, F.array_join(listed, ", ")), key, F.coalesce(F.get_json_object(content, "$.data"), F.lit("")))


def mime_type(name: Column) -> Column:
    """MIME type by a file name's extension."""
    extension = F.lower(F.regexp_extract(name, r"[^/.][^/]*\.([^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension), F.lit("application/octet-stream"))


#: MIME types by extension.
MIME_TYPES = {
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "gif": "image/gif",
    "svg": "image/svg+xml",
    "webp": "image/webp",
    "pdf": "application/pdf",
    "mp4": "video/mp4",
    "mp3": "audio/mpeg",
    "wav": "audio/wav",
}


def file_category(mime: Column) -> Column:
    kind = F.substring_index(mime, "/", 1)
    return F.when(kind.isin("image", "video", "audio"), kind).otherwise("file")
