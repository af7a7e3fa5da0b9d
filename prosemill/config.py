"""Configuration: rule packs, tiers, output, lint levels, plugins."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from .rules.model import LEVELS, Settings

NAME = ".prosemill.toml"
_SECTIONS = {
    "packs": {"builtin": list, "extra_paths": list},
    "scan": {"tiers": list, "respect_gitignore": bool, "extra_globs": list},
    "output": {"format": str, "color": str},
}
#: Text of a first configuration.
TEMPLATE = """\
# Rule packs: names of built-in ones, and further files or folders.
[packs]
builtin = ["starter"]
extra_paths = []

# Tiers that are reported: 1 artifacts, 2 tells, 3 densities. The highest counts.
[scan]
tiers = [1, 2, 3]

[output]
format = "human"
color = "auto"

# allow, note, warn or error by rule id, or by entry as ID#slug.
[lints]

# [plugin.EXCLAIM]
# threshold_gt = 2.0
"""


class ConfigError(Exception):
    pass


@dataclass
class Config:
    builtin: list[str] = field(default_factory=lambda: ["starter"])
    extra_paths: list[str] = field(default_factory=list)
    tiers: list[int] = field(default_factory=lambda: [1, 2, 3])
    extra_globs: list[str] = field(default_factory=list)
    format: str = "human"
    color: str = "auto"
    lints: dict[str, str] = field(default_factory=dict)
    plugins: dict[str, dict[str, Any]] = field(default_factory=dict)
    folder: str | None = None

    def settings(self) -> Settings:
        """Levels by id, ids in any case; the highest tier asked for is the limit."""
        return Settings({k.lower(): v for k, v in self.lints.items()}, max(self.tiers) if self.tiers and max(self.tiers) < 3 else None)


def parse(text: str, folder: str | None = None) -> Config:
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from e
    found = Config(folder=folder)
    for section, table in data.items():
        if section == "lints":
            for rule, level in table.items():
                if level not in LEVELS:
                    raise ConfigError(f"lints: unknown level {level!r} for {rule}")
            found.lints = dict(table)
        elif section == "plugin":
            found.plugins = {k: dict(v) for k, v in table.items()}
        elif section in _SECTIONS:
            for key, value in table.items():
                if key not in _SECTIONS[section]:
                    raise ConfigError(f"{section}: unknown field `{key}`")
                if not isinstance(value, _SECTIONS[section][key]):
                    raise ConfigError(f"{section}: `{key}` must be a {_SECTIONS[section][key].__name__}")
                if hasattr(found, key):
                    setattr(found, key, value)
        else:
            raise ConfigError(f"unknown section `{section}`")
    if found.format not in ("human", "json", "github"):
        raise ConfigError(f"output: unknown format {found.format!r}")
    if found.color not in ("auto", "always", "never"):
        raise ConfigError(f"output: unknown color {found.color!r}")
    return found


def discover(start: str | Path = ".", explicit: str | Path | None = None) -> Config:
    """The explicit file, else the nearest dot file upwards, else the user's, else defaults."""
    places = [Path(explicit)] if explicit else [p / NAME for p in (Path(start).resolve(), *Path(start).resolve().parents)] + [Path.home() / ".config/prosemill/config.toml"]
    for place in places:
        if explicit or place.is_file():
            try:
                return parse(place.read_text("utf-8"), str(place.parent))
            except OSError as e:
                raise ConfigError(str(e)) from e
    return Config()


def plugin_path(declared: str, config_folder: str | None, data_folder: str) -> Path:
    """Absolute paths as they are, ./ ones from the configuration's folder, bare names from the data folder."""
    path = Path(declared)
    if path.is_absolute():
        return path
    return Path(config_folder or ".") / path if declared.startswith(("./", "../")) else Path(data_folder) / path


def pack_root(given: str | Path | None = None) -> Path | None:
    """The folder of packs: the given one, the user's, that of the working folder; None for those of the package only."""
    if given is not None:
        return Path(given)
    return next((p for p in (Path.home() / ".config/prosemill/rules", Path("rules")) if p.is_dir()), None)


def builtin_pack(stem: str, root: Path | None) -> Path:
    """<stem>.toml of the root, else of the package, where `starter` is a folder of packs."""
    if root is not None and (root / f"{stem}.toml").is_file():
        return root / f"{stem}.toml"
    from .rules.loader import starter

    if stem == "starter":
        return starter()
    if (starter() / f"{stem}.toml").is_file():
        return starter() / f"{stem}.toml"
    raise ConfigError(f"packs: no built-in pack {stem!r}" + (f" in {root}" if root else ""))
