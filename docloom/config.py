"""Settings as one frozen, picklable object that is passed explicitly."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, fields
from pathlib import Path
from typing import Any

from docloom.errors import ConfigError


@dataclass(frozen=True)
class Config:
    llm_endpoint: str = "http://localhost:8081/v1/chat/completions"
    llm_model: str = "local-model"
    llm_temperature: float = 0.3
    llm_max_tokens: int = 16384
    llm_timeout: int = 300
    embedding_base_url: str = "http://localhost:11435"
    embedding_model: str = "bge-m3"
    embedding_timeout: int = 60
    embedding_mode: str = "remote"
    embedding_local_model: str | None = None
    embedding_dim: int = 1024
    embedding_batch: int = 32
    hash_fallback: bool = False
    query_instruction: str = "Find passages that answer this question: "
    chunk_size: int = 1024
    chunk_overlap: int = 64
    heading_levels: int = 3
    chunk_threshold_chars: int = 20000
    clean_rules: str | None = None
    chunk_max_tokens: int = 16384
    chunk_timeout: int = 300
    format_timeout: int = 3600
    log_max_bytes: int = 5 << 20
    debug_log_llm_responses: bool = False
    rrf_k: int = 60
    mmr_lambda: float = 0.7

    def problems(self) -> list[str]:
        """What is wrong with these settings."""
        found = []
        for name in ("llm_endpoint", "embedding_base_url"):
            if not str(getattr(self, name)).startswith(("http://", "https://")):
                found.append(f"{name} must be an http(s) address")
        for name in ("llm_max_tokens", "llm_timeout", "embedding_timeout", "embedding_dim", "embedding_batch", "chunk_size", "chunk_threshold_chars", "chunk_max_tokens", "chunk_timeout", "format_timeout", "log_max_bytes", "rrf_k"):
            if getattr(self, name) <= 0:
                found.append(f"{name} must be positive")
        if not 1 <= self.heading_levels <= 6:
            found.append("heading_levels must be from 1 to 6")
        if self.chunk_overlap < 0:
            found.append("chunk_overlap must not be negative")
        if not 0 <= self.llm_temperature <= 2:
            found.append("llm_temperature must be between 0 and 2")
        if not 0 <= self.mmr_lambda <= 1:
            found.append("mmr_lambda must be between 0 and 1")
        if self.embedding_mode not in ("remote", "local", "hash"):
            found.append("embedding_mode must be remote, local or hash")
        if self.embedding_mode == "local" and not self.embedding_local_model:
            found.append("embedding_local_model is needed in local mode")
        return found

    def checked(self) -> Config:
        if found := self.problems():
            raise ConfigError("; ".join(found))
        return self

    def as_dict(self) -> dict[str, Any]:
        return asdict(self)


def load_config(path: str | Path | None = None) -> Config:
    """Settings of a YAML file: the path given, $DOCLOOM_CONFIG, conf/config.yaml, or the defaults.

    The file may nest one level: ``llm: {model: x}`` is ``llm_model``.
    """
    choices = [path, os.environ.get("DOCLOOM_CONFIG"), "conf/config.yaml", "conf/config.example.yaml"]
    found = next((Path(c) for c in choices if c and Path(c).is_file()), None)
    if found is None:
        if path:
            raise ConfigError(f"no such file: {path}")
        return Config().checked()
    import yaml

    raw = yaml.safe_load(found.read_text(encoding="utf-8")) or {}
    if not isinstance(raw, dict):
        raise ConfigError(f"{found} holds no mapping")
    flat: dict[str, Any] = {}
    known = {f.name for f in fields(Config)}
    for key, value in raw.items():
        for name, v in value.items() if isinstance(value, dict) else [("", value)]:
            for full in (f"{key}_{name}".rstrip("_"), name, key):
                if full in known:
                    flat[full] = v
                    break
    return Config(**flat).checked()
