"""Text to vectors: a hashing embedder, local ONNX models, remote services, and their settings."""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import tomllib
import urllib.error
import urllib.request
from dataclasses import dataclass
from pathlib import Path

import numpy as np

from graphmill.errors import ModelUnavailable, ValidationError
from graphmill.functions.vectors import normalised

POOLINGS = ("mean", "cls", "last_token")
#: Settings where a shelf has none.
DEFAULT_DIMENSIONS, DEFAULT_MAX_LENGTH = 1024, 8192
REMOTE_URL, REMOTE_KEY, REMOTE_MODEL = "https://api.openai.com/v1/embeddings", "OPENAI_API_KEY", "text-embedding-3-small"
TRIES, FIRST_WAIT, TIMEOUT = 3, 0.5, 60


@dataclass
class Settings:
    """The ``[embedding]`` section of ``shelf.toml``."""

    provider: str = "local"
    model_path: Path = Path("embedding_model.onnx")
    tokenizer_path: Path = Path("tokenizer.json")
    dimensions: int = DEFAULT_DIMENSIONS
    max_seq_length: int = DEFAULT_MAX_LENGTH
    pooling: str = "mean"
    api_url: str = REMOTE_URL
    api_key_env: str = REMOTE_KEY
    api_model: str = REMOTE_MODEL

    @classmethod
    def read(cls, folder: str | os.PathLike, models: str | os.PathLike | None = None) -> Settings:
        """Settings of a shelf's folder; a missing or malformed file means the defaults."""
        folder = Path(folder)
        try:
            said = tomllib.loads((folder / "shelf.toml").read_text()).get("embedding", {})
        except (OSError, tomllib.TOMLDecodeError):
            said = {}
        found = resolve_model(said["model"], models) if said.get("model") else None
        local = found or (Path(said.get("model_path", folder / "embedding_model.onnx")), Path(said.get("tokenizer_path", folder / "tokenizer.json")))
        plain = {n: said[n] for n in ("dimensions", "max_seq_length", "pooling", "api_url", "api_key_env", "api_model") if n in said}
        if plain.get("pooling", "mean") not in POOLINGS:
            plain.pop("pooling")
        return cls(provider="remote" if said.get("provider") == "remote" else "local", model_path=local[0], tokenizer_path=local[1], **plain)


def resolve_model(reference: str, models: str | os.PathLike | None = None) -> tuple[Path, Path] | None:
    """Model and tokenizer files of a reference: a folder, a name below ``models``, or the newest usable cached snapshot."""
    models = Path(models) if models else Path.home() / ".graphmill" / "models"
    candidates = [Path(reference)] if os.path.isabs(reference) else [models / reference]
    if not os.path.isabs(reference):
        cache = Path(os.environ.get("HF_HOME", Path.home() / ".cache" / "huggingface")) / "hub" / f"models--{reference.replace('/', '--')}" / "snapshots"
        if cache.is_dir():
            candidates += sorted(cache.iterdir(), key=lambda p: p.stat().st_mtime, reverse=True)
    for folder in candidates:
        for name in ("embedding_model.onnx", "model.onnx", "onnx/model.onnx"):
            if (folder / name).exists() and (folder / "tokenizer.json").exists():
                return folder / name, folder / "tokenizer.json"
    return None


def list_models(models: str | os.PathLike) -> list[str]:
    root = Path(models)
    return sorted({str(p.parent.relative_to(root)) for p in root.rglob("tokenizer.json")}) if root.is_dir() else []


def register_model(reference: str, source: str | os.PathLike, models: str | os.PathLike) -> Path:
    """Link a folder with model files under a name."""
    if resolve_model(str(Path(source).resolve())) is None:
        raise ValidationError(f"no model files in {source}")
    target = Path(models) / reference
    if not target.resolve().is_relative_to(Path(models).resolve()):
        raise ValidationError(f"not a model name: {reference!r}")
    target.parent.mkdir(parents=True, exist_ok=True)
    if target.is_symlink():
        target.unlink()
    target.symlink_to(Path(source).resolve())
    return target


class NoEmbedder:
    """Stands where no model is configured."""

    available = False

    def embed(self, text: str) -> list[float]:
        raise ModelUnavailable("no embedding model")


@dataclass
class HashEmbedder:
    """Signed word hashing: deterministic, needs no model; texts that share words come close."""

    dimensions: int = 64
    available = True

    def embed(self, text: str) -> list[float]:
        vector = np.zeros(self.dimensions)
        for word in re.findall(r"\w+", text.lower()):
            digest = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            vector[digest % self.dimensions] += 1.0 if digest >> 63 else -1.0
        return normalised(vector.tolist())


def pool(hidden: np.ndarray, mask: np.ndarray, pooling: str) -> np.ndarray:
    """One vector from token vectors [tokens, width] and their attention mask."""
    if pooling == "cls":
        return hidden[0]
    if pooling == "last_token":
        return hidden[int(np.flatnonzero(mask)[-1])] if mask.any() else hidden[-1]
    weight = mask.astype(hidden.dtype)[:, None]
    return (hidden * weight).sum(0) / max(float(weight.sum()), 1e-9)


_sessions: dict = {}


@dataclass
class OnnxEmbedder:
    """A local sentence model.  Files are loaded once in each Python worker, at first use."""

    settings: Settings

    @property
    def available(self) -> bool:
        return self.settings.model_path.exists() and self.settings.tokenizer_path.exists()

    def _loaded(self):
        key = str(self.settings.model_path)
        if key not in _sessions:
            if not self.available:
                raise ModelUnavailable(f"no model at {self.settings.model_path}")
            import onnxruntime
            from tokenizers import Tokenizer

            _sessions[key] = onnxruntime.InferenceSession(key), Tokenizer.from_file(str(self.settings.tokenizer_path))
        return _sessions[key]

    def embed(self, text: str) -> list[float]:
        session, tokenizer = self._loaded()
        encoded = tokenizer.encode(text)
        ids = np.array([encoded.ids[: self.settings.max_seq_length]], np.int64)
        mask = np.array([encoded.attention_mask[: self.settings.max_seq_length]], np.int64)
        feed = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        outputs = session.run(None, {i.name: feed[i.name] for i in session.get_inputs() if i.name in feed})
        if len(outputs) > 1:  # a sentence vector of the model's own
            return normalised(np.asarray(outputs[1])[0].tolist())
        return normalised(pool(np.asarray(outputs[0])[0], mask[0], self.settings.pooling).tolist())


@dataclass
class RemoteEmbedder:
    """An embedding service with the usual request form.  Vectors are used as they come."""

    settings: Settings

    @property
    def available(self) -> bool:
        return bool(os.environ.get(self.settings.api_key_env))

    def embed(self, text: str) -> list[float]:
        return self.embed_batch([text])[0]

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        key = os.environ.get(self.settings.api_key_env)
        if not key:
            raise ModelUnavailable(f"{self.settings.api_key_env} is not set")
        body = json.dumps({"model": self.settings.api_model, "input": texts}).encode()
        request = urllib.request.Request(self.settings.api_url, body, {"Authorization": f"Bearer {key}", "Content-Type": "application/json"})
        for attempt in range(TRIES):
            try:
                with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
                    rows = json.load(answer)["data"]
                return [r["embedding"] for r in sorted(rows, key=lambda r: r.get("index", 0))]
            except urllib.error.HTTPError as error:
                if error.code != 429 or attempt == TRIES - 1:
                    raise ModelUnavailable(f"the service answered {error.code}") from None
            except urllib.error.URLError as error:
                if attempt == TRIES - 1:
                    raise ModelUnavailable(f"the service cannot be reached: {error.reason}") from None
            time.sleep(FIRST_WAIT * 2**attempt)
        raise ModelUnavailable("no answer")


def embedder_for(folder: str | os.PathLike):
    """The embedder a shelf's settings ask for."""
    settings = Settings.read(folder)
    found = RemoteEmbedder(settings) if settings.provider == "remote" else OnnxEmbedder(settings)
    return found if found.available else NoEmbedder()
