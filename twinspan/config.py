"""Layered configuration: defaults, then a global, then a project TOML file."""

from __future__ import annotations

import os
import shlex
import subprocess
import tomllib
from dataclasses import dataclass, fields, replace

SCHEMA_VERSION = 1
PROJECT_FILE = ".twinspan.toml"


class ConfigError(ValueError):
    """A file that cannot be read as configuration."""


class NewerSchema(ConfigError):
    """A file written for a later schema version."""


@dataclass(frozen=True)
class Config:
    tier_a_min_lines: int = 6
    tier_a_min_tokens: int = 50
    tier_b_min_lines: int = 3
    tier_b_min_tokens: int = 15
    normalization: str = "conservative"
    max_file_size: int = 1 << 20
    follow_symlinks: bool = False
    include_submodules: bool = False
    context_lines: int = 3


#: TOML table and key of each field.
_PLACES = {
    "tier_a_min_lines": ("thresholds", "tier_a", "min_lines"),
    "tier_a_min_tokens": ("thresholds", "tier_a", "min_tokens"),
    "tier_b_min_lines": ("thresholds", "tier_b", "min_lines"),
    "tier_b_min_tokens": ("thresholds", "tier_b", "min_tokens"),
    "normalization": ("normalization",),
    "max_file_size": ("scan", "max_file_size"),
    "follow_symlinks": ("scan", "follow_symlinks"),
    "include_submodules": ("scan", "include_submodules"),
    "context_lines": ("detail", "context_lines"),
}


def global_path() -> str:
    base = os.environ.get("XDG_CONFIG_HOME") or os.path.join(os.path.expanduser("~"), ".config")
    return os.path.join(base, "twinspan", "config.toml")


def project_path(root: str) -> str:
    return os.path.join(root, PROJECT_FILE)


def _flat(tree: dict, at: tuple[str, ...] = ()) -> dict[tuple[str, ...], object]:
    out = {}
    for k, v in tree.items():
        out |= _flat(v, (*at, k)) if isinstance(v, dict) else {(*at, k): v}
    return out


def overlay(config: Config, text: str) -> Config:
    """Take over what a TOML text sets; unknown keys are errors."""
    try:
        found = _flat(tomllib.loads(text))
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from e
    if (version := found.pop(("schema_version",), SCHEMA_VERSION)) != SCHEMA_VERSION:
        raise (NewerSchema if isinstance(version, int) and version > SCHEMA_VERSION else ConfigError)(f"schema_version {version}")
    names = {place: name for name, place in _PLACES.items()}
    if unknown := set(found) - set(names):
        raise ConfigError("unknown keys: " + ", ".join(sorted(map(".".join, unknown))))
    values = {names[p]: v for p, v in found.items()}
    for f in fields(Config):
        want = type(f.default)
        if f.name in values and (not isinstance(values[f.name], want) or want is int and isinstance(values[f.name], bool)):
            raise ConfigError(f"{'.'.join(_PLACES[f.name])} must be of type {want.__name__}")
    if values.get("normalization", "conservative") not in ("conservative", "aggressive"):
        raise ConfigError("normalization must be conservative or aggressive")
    return replace(config, **values)


def load(root: str) -> Config:
    """Defaults under the global file under the project's file."""
    config = Config()
    for path in (global_path(), project_path(root)):
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                config = overlay(config, f.read())
    return config


def edit(root: str, everywhere: bool = False) -> int:
    """Open the project's or the user's file in $VISUAL or $EDITOR, making it first; the editor's exit code, 2 without one."""
    editor = shlex.split(os.environ.get("VISUAL") or os.environ.get("EDITOR") or "")
    if not editor:
        return 2
    path = global_path() if everywhere else project_path(root)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    if not os.path.exists(path):
        with open(path, "w", encoding="utf-8") as f:
            f.write(f"schema_version = {SCHEMA_VERSION}\n")
    code = subprocess.run([*editor, path]).returncode
    load(root)  # what does not hold is told at once
    return code
