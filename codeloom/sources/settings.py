"""Settings and registries as JSON files."""

from __future__ import annotations

import json
import os
from typing import Any

#: Settings where none are stored.
DEFAULTS: dict[str, Any] = {"first_run_completed": False, "ai_enabled": False, "ollama_host": "http://localhost:11434", "ollama_model": "qwen2.5-coder:3b", "ollama_models_dir": ""}


def load(path: str, defaults: dict[str, Any] | None = None) -> dict[str, Any]:
    """The stored settings over the defaults; the defaults alone if the file is missing or no JSON object."""
    try:
        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
    except (OSError, ValueError):
        stored = None
    return {**(DEFAULTS if defaults is None else defaults), **(stored if isinstance(stored, dict) else {})}


def _replace(path: str, content: dict[str, Any]) -> None:
    """Write a file beside the old one and put it in its place; its folder is made where it is not there."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump(content, f, indent=2)
    os.replace(f"{path}.tmp", path)


def save(path: str, changes: dict[str, Any]) -> dict[str, Any]:
    """Merge changes into the stored settings and replace the file at once."""
    merged = {**load(path), **changes}
    _replace(path, merged)
    return merged


def _migrated(settings: dict[str, Any]) -> list[dict[str, Any]]:
    """The one record of a registry that is not there yet, from the settings of older versions. Its names."""
    model = settings.get("ollama_model", DEFAULTS["ollama_model"])
    return [
        {
            "id": "ollama-default", "provider": "ollama", "display_name": f"Ollama ({model})", "model_name": model, "api_key_encrypted": None, "masked_key": "",
            "base_url": settings.get("ollama_host", DEFAULTS["ollama_host"]), "enabled": True, "is_default_chat": True, "is_default_architecture": True,
        }
    ]


def load_registry(path: str, settings_path: str) -> list[dict[str, Any]]:
    """The records of a registry file {version, models}. Where it is missing or has none, the record of the stored settings, which is then saved; a broken file is left as it is."""
    try:
        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
    except FileNotFoundError:
        stored = {}
    except (OSError, ValueError):
        return _migrated(load(settings_path))
    records = stored.get("models") if isinstance(stored, dict) else None
    if not records:
        records = _migrated(load(settings_path))
        save_registry(path, records)
    return records


def save_registry(path: str, records: list[dict[str, Any]]) -> None:
    """Replace the registry file at once."""
    _replace(path, {"version": 1, "models": records})
