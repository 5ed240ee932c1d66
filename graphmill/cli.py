"""Command line and interactive prompt."""

from __future__ import annotations

import argparse
import json
import shlex
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from graphmill.errors import GraphmillError, ParseError
from graphmill.functions.content import Content, triple_key
from graphmill.sources.embedding import Settings, list_models, register_model, resolve_model
from graphmill.sources.registry import DEFAULT
from graphmill.workspace import Workspace


def shape(row) -> dict:
    """A result row as JSON: content decoded, times as text, absent ends of a period left out."""
    values = row.asDict(recursive=True)
    for name in ("created_at", "tr_start", "tr_end"):
        if name in values:
            values[name] = None if values[name] is None else values[name].isoformat(" ")
            if values[name] is None and name != "created_at":
                del values[name]
    if isinstance(values.get("content"), str) and {"triple", "name"} & values.keys():
        try:
            values["content"] = json.loads(values["content"])
        except ValueError:
            pass
    return values


def show(rows: DataFrame) -> str:
    """Result rows, which a query's limit bounds, as a JSON array."""
    found = [shape(r) for r in rows.toLocalIterator()]
    return json.dumps(found, indent=2, ensure_ascii=False, default=str) if found else "No results found."


def listed(text: str, keep_empty: bool = False) -> list[str]:
    """Comma-separated parts, trimmed."""
    parts = [p.strip() for p in text.split(",")] if text else []
    return parts if keep_empty else [p for p in parts if p]


def scopes(text: str) -> list[str]:
    """Scopes; a comma at the end adds the global scope."""
    return listed(text) + ([""] if text.endswith(",") else [])


def parser() -> argparse.ArgumentParser:
    root = argparse.ArgumentParser(prog="graphmill")
    root.add_argument("--home")
    commands = root.add_subparsers(dest="command")

    def add(name: str, /, *words: str, **options: object) -> None:
        command = commands.add_parser(name)
        for word in words:
            command.add_argument(word)
        for option, default in options.items():
            kind = type(default) if isinstance(default, int) else str
            command.add_argument("--" + option.replace("_", "-"), default=default, type=kind)

    add("connect", "path", name=None)
    add("disconnect", "name")
    add("list")
    add("query", "expression", shelf=DEFAULT)
    add("knowledge-create", "name", data="", tags="", synonyms="", figures="", scopes="", shelf=DEFAULT)
    add("knowledge-get", "name", shelf=DEFAULT)
    add("knowledge-delete", "name", shelf=DEFAULT)
    add("statement-create", "subject", "predicate", "object", data="", synonyms=None, scopes="", shelf=DEFAULT)
    add("statement-delete", "subject", "predicate", "object", shelf=DEFAULT)
    add("search", "text", catalog=None, limit=100, offset=0, shelf=DEFAULT)
    add("similar", "text", target="knowledge", limit=10, shelf=DEFAULT)
    add("export", "name", "destination")
    add("backfill", shelf=DEFAULT)
    add("compact", shelf=DEFAULT)
    add("archive-store", "file", name=None, shelf=DEFAULT)
    add("archive-get", "name", output=None, shelf=DEFAULT)
    add("archive-list", shelf=DEFAULT)
    add("model-list")
    add("model-register", "name", "source")
    add("model-show", shelf=DEFAULT)
    add("repl")
    return root


def run(space: Workspace, args: argparse.Namespace) -> str:
    """Carry out one command and say what happened."""
    shelf = space.shelf(args.shelf) if getattr(args, "shelf", None) else None
    models = space.home / "models"
    match args.command:
        case "connect":
            return f"Shelf '{space.connect(args.path, args.name)}' connected."
        case "disconnect":
            space.disconnect(args.name)
            return f"Shelf '{args.name}' disconnected."
        case "list":
            return "\n".join(f"  {n}  {p}  [{'connected' if c else 'disconnected'}]" for n, p, c in space.list()) or "No shelves."
        case "query":
            return show(shelf.query(args.expression))
        case "knowledge-create":
            content = Content(args.data, tags=listed(args.tags, True), synonyms=listed(args.synonyms) or None, figures=listed(args.figures), scopes=scopes(args.scopes))
            return f"Created knowledge: {shelf.create_knowledge(args.name, content).name}"
        case "knowledge-get":
            row = shelf.get("knowledge", args.name)
            return json.dumps({k: v for k, v in shape(row).items() if k != "embedding"}, indent=2, ensure_ascii=False) if row else f"Knowledge '{args.name}' not found."
        case "knowledge-delete":
            shelf.delete("knowledge", args.name)
            return f"Deleted knowledge: {args.name}"
        case "statement-create":
            try:
                synonyms = json.loads(args.synonyms) if args.synonyms else None
            except ValueError as error:
                raise ParseError(f"invalid synonyms: {error}") from None
            shelf.create_statement(args.subject, args.predicate, args.object, Content(args.data, synonyms=synonyms, scopes=scopes(args.scopes)))
            return f"Created statement: ({args.subject}, {args.predicate}, {args.object})"
        case "statement-delete":
            shelf.delete("statement", triple_key(args.subject, args.predicate, args.object))
            return f"Deleted statement: ({args.subject}, {args.predicate}, {args.object})"
        case "search":
            return show(shelf.search(args.text, args.catalog, args.limit, args.offset))
        case "similar":
            return show(shelf.similar(args.text, args.target, args.limit))
        case "export":
            space.shelf(args.name).export(args.destination)
            return f"Exported shelf '{args.name}' to {args.destination}"
        case "backfill":
            done = shelf.backfill()
            return f"Backfill complete: {done['created']} vectors created, {done['skipped']} skipped, {done['errors']} errors"
        case "compact":
            shelf.compact()
            return "Compacted."
        case "archive-store":
            return f"Stored: archive://{space.store_file(args.shelf, args.file, args.name)}"
        case "archive-get":
            path = shelf.archive_path(args.name)
            if path is None:
                return f"Archive '{args.name}' not found."
            if args.output:
                shelf.files.download(path, args.output)
            return f"Copied to: {args.output}" if args.output else str(path)
        case "archive-list":
            files = shelf.list_archives()
            return "\n".join([f"  archive://{f}" for f in files] + [f"  ({len(files)} files)"]) if files else "No archived files."
        case "model-list":
            return "\n".join(list_models(models)) or "No models."
        case "model-register":
            return f"Registered {register_model(args.name, args.source, models)}"
        case "model-show":
            settings = Settings.read(shelf.path, models)
            return "\n".join(f"{k}: {v}" for k, v in vars(settings).items()) + f"\nresolved: {bool(resolve_model(str(settings.model_path.parent), models))}"
    raise ParseError(f"unknown command {args.command}")


HELP = ".help  .connect PATH [NAME]  .disconnect NAME  .list  .export NAME DEST  .quit; a line that begins with { or [ is a query on the default shelf"


def respond(space: Workspace, line: str) -> str | None:
    """The answer to a line of the prompt; None ends it."""
    line = line.strip()
    if not line:
        return ""
    if line[0] in "{[":
        return show(space.query(DEFAULT, line))
    if line in (".quit", ".exit"):
        return None
    if line == ".help":
        return HELP
    if line.startswith("."):
        words = shlex.split(line[1:])
        if words and words[0] in ("connect", "disconnect", "list", "export"):
            if words[0] == "connect" and len(words) == 3:
                words[2:] = ["--name", words[2]]
            try:
                return run(space, parser().parse_args(words))
            except SystemExit:
                return HELP
    return f"unknown command; {HELP}"


def repl(space: Workspace) -> None:
    for line in sys.stdin:
        try:
            answer = respond(space, line)
        except GraphmillError as error:
            answer = f"error: {error}"
        if answer is None:
            return
        print(answer)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("graphmill").getOrCreate()
    space = Workspace(spark, Path(args.home) if args.home else None)
    try:
        if args.command in (None, "repl"):
            repl(space)
        else:
            print(run(space, args))
    except GraphmillError as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
