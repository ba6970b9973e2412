"""Configuration: nested defaults that files and options override."""

from __future__ import annotations

import json
from pathlib import Path

DEFAULTS = {
    "data": {"name": "ml-100k", "test_ratio": 0.1, "valid_ratio": 0.1, "inductive_key": None, "node_percent": 20, "edge_percent": 90},
    "model": {"units": 32, "blocks": 2, "combine": "sum", "act": "leaky", "ordinal": False, "neighbors": -1, "mask": {"zero": 0.9, "keep": 0.1}},
    "train": {"steps": 100, "rate": 0.01, "clip": 1.0, "decay": 0.5, "patience": 10, "least_rate": 0.001, "batch": 10000},
    "seed": 123,
}


def merged(base: dict, over: dict, at: str = "") -> dict:
    """base with the values of over: unknown keys and other types are errors, numbers may replace numbers, anything may replace None."""
    out = dict(base)
    for key, value in over.items():
        here = f"{at}.{key}".lstrip(".")
        if key not in base:
            raise KeyError(here)
        old = base[key]
        if isinstance(old, dict):
            if not isinstance(value, dict):
                raise TypeError(f"{here} is a section")
            out[key] = merged(old, value, here)
        else:
            number = lambda v: isinstance(v, int | float) and not isinstance(v, bool)
            if old is not None and type(old) is not type(value) and not (number(old) and number(value)):
                raise TypeError(f"{here} is a {type(old).__name__}")
            out[key] = value
    return out


def checked(config: dict) -> dict:
    mask = config["model"]["mask"]
    if abs(mask["zero"] + mask["keep"] - 1) > 1e-9:
        raise ValueError("mask shares must add up to 1")
    return config


def load(path: str | None = None, **options) -> dict:
    over = json.loads(Path(path).read_text()) if path else {}
    return checked(merged(merged(DEFAULTS, over), options))


def dump(config: dict, folder: str) -> Path:
    """Writes the next numbered version into a folder, and returns its path."""
    at = Path(folder)
    at.mkdir(parents=True, exist_ok=True)
    known = [int(p.stem.removeprefix("config")) for p in at.glob("config*.json") if p.stem.removeprefix("config").isdigit()]
    path = at / f"config{max(known, default=-1) + 1}.json"
    path.write_text(json.dumps(config, indent=2))
    return path
