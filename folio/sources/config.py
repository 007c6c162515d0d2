"""Settings: defaults, a JSON file over them, an environment file. Nothing is read or written on import."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """Numbers that operators take as parameters."""

    section_chars: int = 4000
    chunk_chars: int = 2500
    min_chunk_chars: int = 650
    rescue_chars: int = 600
    summary_chunk_chars: int = 6000
    summary_fan_in: int = 5
    min_pages: int = 3
    caption_distance: int = 120
    figure_gap: int = 35
    drawing_gap: int = 6
    request_timeout: int = 120


def load_settings(path: str | None = None) -> Settings:
    """Defaults overridden by the integers of a JSON file; unknown keys are ignored, a missing file is none."""
    if path is None or not Path(path).exists():
        return Settings()
    known = {f.name for f in fields(Settings)}
    found = json.loads(Path(path).read_text(encoding="utf-8"))
    return replace(Settings(), **{k: int(v) for k, v in found.items() if k in known})


def parse_env(text: str) -> dict[str, str]:
    """KEY=VALUE lines; blank lines and comments are skipped, quotes around a value are cut."""
    out = {}
    for line in text.splitlines():
        key, sep, value = line.partition("=")
        if sep and key.strip() and not key.lstrip().startswith("#"):
            out[key.strip()] = value.strip().strip("'\"")
    return out


def load_env(path: str) -> None:
    """Sets variables of a file that aren't set yet."""
    if Path(path).exists():
        for k, v in parse_env(Path(path).read_text(encoding="utf-8")).items():
            os.environ.setdefault(k, v)
