"""Settings as frozen dataclasses, with defaults, from a dict or from a file."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields, is_dataclass


@dataclass(frozen=True)
class Embedding:
    dimension: int = 256
    metric: str = "cosine"
    batch_size: int = 1000


@dataclass(frozen=True)
class Chunking:
    max_hierarchy_depth: int = 2
    max_file_lines: int = 1000


@dataclass(frozen=True)
class Sync:
    debounce_seconds: float = 1.0
    exclude_patterns: tuple[str, ...] = (r"^node_modules/", r"^\.venv/", r"^venv/", r"^env/", r"^__pycache__/", r"^dist/", r"^build/", r"\.pyc$", r"\.so$")


@dataclass(frozen=True)
class Diffs:
    similarity: float = 0.6
    move_similarity: float = 0.85
    part_limit: int = 50_000


@dataclass(frozen=True)
class Settings:
    embedding: Embedding = field(default_factory=Embedding)
    chunking: Chunking = field(default_factory=Chunking)
    sync: Sync = field(default_factory=Sync)
    diffs: Diffs = field(default_factory=Diffs)


def settings(values: dict | None = None, kind: type = Settings):
    """Settings from nested dicts; missing keys keep their default, unknown ones raise ValueError."""
    values = values or {}
    names = {f.name: f for f in fields(kind)}
    if unknown := set(values) - set(names):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    default = kind()
    out = {}
    for n, v in values.items():
        own = getattr(default, n)
        out[n] = settings(v, type(own)) if is_dataclass(own) else tuple(v) if isinstance(own, tuple) else v
    return kind(**out)


#: Names of a settings file, in the order in which they are looked for, and the variable that names one instead.
FILES, VARIABLE = ("sparkloom.yml", "sparkloom.yaml", "sparkloom.json"), "SPARKLOOM_CONFIG"


def load(folder: str = ".", environment: dict | None = None) -> Settings:
    """Settings of the file that the environment names, else of the first of FILES in the folder or those above it, else the defaults. YAML needs the yaml package."""
    environment = os.environ if environment is None else environment
    path = environment.get(VARIABLE)
    at = os.path.abspath(folder)
    while path is None:
        path = next((p for p in (os.path.join(at, f) for f in FILES) if os.path.isfile(p)), None)
        if at == os.path.dirname(at):
            break
        at = os.path.dirname(at)
    if path is None:
        return settings()
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        values = json.loads(text)
    else:
        try:
            import yaml
        except ModuleNotFoundError as gone:
            raise ValueError(f"{path} needs the yaml package; use a .json file") from gone
        values = yaml.safe_load(text)
    if values is not None and not isinstance(values, dict):
        raise ValueError(f"{path} holds no settings")
    return settings(values)
