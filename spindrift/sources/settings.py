"""Typed settings with environment overrides."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """Defaults are fixed values; each is overridden by the variable of its upper-case name."""

    base_dir: Path = field(default_factory=lambda: Path("."))
    pipeline_version: str = "1.1"
    groq_timeout: float = 20.0
    retrieval_top_k: int = 50
    rrf_k: int = 60
    rerank_candidates: int = 20
    final_top_k: int = 5
    rerank_batch_size: int = 16
    context_max_chars: int = 2000
    eval_throttle_sec: float = 0.5
    min_chunk_chars: int = 100
    gc_interval_pdfs: int = 50
    max_checkpoint_bytes: int = 500 * 1024 * 1024

    def folder(self, name: str) -> Path:
        return self.base_dir / name


#: Folders below the base folder.
FOLDERS = ("data", "processed", "manifests", "stores")


def load_settings(base_dir: str | Path | None = None, env: Mapping[str, str] = os.environ) -> Settings:
    """Settings from the environment; what is unset or can't be parsed keeps its default. The base
    folder is the argument, else RAG_BASE_DIR, else the current one; its folders are created."""
    values: dict[str, object] = {"base_dir": Path(base_dir or env.get("RAG_BASE_DIR") or ".")}
    for f in fields(Settings):
        if f.name == "base_dir" or (raw := env.get(f.name.upper())) is None:
            continue
        try:
            values[f.name] = type(f.default)(raw)
        except ValueError:
            pass
    made = Settings(**values)
    for name in FOLDERS:
        made.folder(name).mkdir(parents=True, exist_ok=True)
    return made
