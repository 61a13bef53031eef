"""Settings as nested dicts: YAML files merged in order, then overrides like `train.lr=0.1`. They never touch Spark's own."""

from __future__ import annotations

import ast
from pathlib import Path


def merged(base: dict, other: dict) -> dict:
    """A new dict; where both have a dict they are merged, else the other's value wins."""
    both = {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in other.items()}
    return base | both


def value_of(text: str):
    """A Python literal where the text is one, else the text."""
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError):
        return text


def overridden(config: dict, override: str) -> dict:
    path, found, text = override.partition("=")
    if not found:
        raise ValueError(f"override {override!r} must be key=value")
    value = value_of(text.strip())
    for key in reversed(path.strip().split(".")):
        value = {key: value}
    return merged(config, value)


def load(*paths: str | Path, overrides: list[str] | None = None) -> dict:
    import yaml

    config: dict = {}
    for path in paths:
        config = merged(config, yaml.safe_load(Path(path).read_text()) or {})
    for override in overrides or []:
        config = overridden(config, override)
    return config


def load_experiment(experiment: str | Path, folder: str | Path = "configs", overrides: list[str] | None = None) -> dict:
    """default.yaml of the folder, then the experiment: a path that exists, or a name within the folder."""
    tried = [Path(experiment), Path(folder) / experiment]
    for path in tried:
        if path.exists():
            return load(Path(folder) / "default.yaml", path, overrides=overrides)
    raise FileNotFoundError(f"no config at {' or '.join(map(str, tried))}")
