"""Settings in a JSON file: what can't be read counts as none, a write replaces the file at once."""

from __future__ import annotations

import json
import os
import tempfile
from contextlib import suppress
from pathlib import Path


def load(path: Path) -> dict:
    try:
        found = json.loads(path.read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def save(path: Path, settings: dict) -> None:
    with suppress(OSError):
        path.parent.mkdir(parents=True, exist_ok=True)
        with tempfile.NamedTemporaryFile("w", dir=path.parent, delete=False, encoding="utf-8") as f:
            json.dump(settings, f, indent=2, ensure_ascii=False)
        os.replace(f.name, path)


def update(path: Path, key: str, value: object) -> dict:
    settings = load(path) | {key: value}
    save(path, settings)
    return settings
