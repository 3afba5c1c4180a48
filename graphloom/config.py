"""Settings from arguments, environment, ``.env``, a file and defaults, in this order."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import dataclass, fields

PREFIX = "GRAPHLOOM_"


@dataclass(frozen=True)
class Settings:
    model_path: str = ""
    db_root: str = ".graphloom"
    dimensions: int = 384


def env_file(path: str) -> dict[str, str]:
    out = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                key, found, value = line.strip().removeprefix("export ").partition("=")
                if found and not key.startswith("#"):
                    out[key.strip()] = value.strip().strip("'\"")
    return out


def config_file(path: str | None) -> dict[str, object]:
    """Values of a JSON or TOML file, or of flat ``key: value`` lines."""
    if not path or not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    if path.endswith(".toml"):
        return tomllib.loads(text)
    pairs = (line.partition(":") for line in text.split("\n") if ":" in line and not line.lstrip().startswith("#"))
    return {k.strip(): v.strip().strip("'\"") for k, _, v in pairs}


def resolve(given: dict[str, object] | None = None, folder: str = ".", path: str | None = None) -> Settings:
    stored, local = config_file(path), env_file(os.path.join(folder, ".env"))
    out = {}
    for f in fields(Settings):
        name = PREFIX + f.name.upper()
        for value in ((given or {}).get(f.name), os.environ.get(name), local.get(name), stored.get(f.name)):
            if value not in (None, ""):
                out[f.name] = type(f.default)(value)
                break
    return Settings(**out)
