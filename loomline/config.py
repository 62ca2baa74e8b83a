"""Settings: defaults, a TOML file, and the command line on top of it."""

from __future__ import annotations

import os
import sys
import tomllib
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from .functions.formats import NumberStyle, SizeUnits
from .operators.aggregate import SortKey
from .report import FORMATS, Verbosity, View
from .sources.files import Walk

FILE = "loomline.toml"


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Config:
    path: str = "."
    verbosity: str = "regular"
    respect_gitignore: bool = True
    include_generated: bool = False
    include_hidden: bool = False
    follow_symlinks: bool = False
    max_depth: int | None = None
    exclude: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    exclude_languages: tuple[str, ...] = ()
    number_style: str = "plain"
    size_units: str = "binary"
    precision: int = 1
    sort_by: str = "lines"
    sort_direction: str = "desc"
    indent: str = "tab"
    output: str = "human"
    top_languages: int | None = None
    min_lines: int | None = None
    by_dir: bool = False
    fail_on_error: bool = False
    catalog: str | None = None

    def checked(self) -> Config:
        if self.languages and self.exclude_languages:
            raise ConfigError("languages are either included or excluded")
        for name, kinds in (("verbosity", [v.name.lower() for v in Verbosity]), ("number_style", list(NumberStyle)), ("size_units", list(SizeUnits)), ("sort_by", list(SortKey)), ("sort_direction", ["asc", "desc"]), ("output", FORMATS)):
            if getattr(self, name) not in kinds:
                raise ConfigError(f"{name}: {getattr(self, name)} is none of {', '.join(kinds)}")
        indent(self.indent)
        return replace(self, precision=min(6, max(0, self.precision)))

    @property
    def walk(self) -> Walk:
        return Walk(self.respect_gitignore, self.include_hidden, self.follow_symlinks, self.max_depth, tuple(self.exclude), self.include_generated)

    @property
    def view(self) -> View:
        return View(Verbosity[self.verbosity.upper()], NumberStyle(self.number_style), SizeUnits(self.size_units), self.precision, SortKey(self.sort_by), self.sort_direction == "desc", indent(self.indent), self.top_languages, self.min_lines, self.by_dir)


def indent(text: str) -> str:
    """tab, or a number of spaces from 1 to 8."""
    if text == "tab":
        return "\t"
    if str(text).isdigit() and 1 <= int(text) <= 8:
        return " " * int(text)
    raise ConfigError(f"indent: {text} is neither tab nor 1 to 8")


def parse(text: str) -> dict:
    """Known settings of a TOML text, flat or in tables; others are passed over."""
    raw: dict = {}

    def take(table: dict) -> None:
        for k, v in table.items():
            if isinstance(v, dict):
                take(v)
            else:
                raw[k.replace("-", "_")] = v

    try:
        take(tomllib.loads(text))
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from e
    known = {f.name for f in fields(Config)}
    return {k: tuple(v) if isinstance(v, list) else str(v) if k == "indent" else v for k, v in raw.items() if k in known}


def from_file(path: str | Path) -> Config:
    """A relative path in it counts from the file's folder."""
    path = Path(path)
    got = parse(path.read_text(encoding="utf-8"))
    if "path" in got and not os.path.isabs(got["path"]):
        got["path"] = os.path.normpath(path.parent / got["path"])
    return Config(**got)


def places(cwd: Path | None = None, env: dict[str, str] | None = None) -> list[Path]:
    """Where a settings file is looked for, in order."""
    cwd, env = cwd or Path.cwd(), os.environ if env is None else env
    home = Path(env.get("HOME") or Path.home())
    if env.get("XDG_CONFIG_HOME"):
        own = Path(env["XDG_CONFIG_HOME"])
    elif sys.platform == "darwin":
        own = home / "Library/Application Support"
    elif sys.platform == "win32":
        own = Path(env.get("APPDATA") or home)
    else:
        own = home / ".config"
    return [cwd / f".{FILE}", cwd / FILE, own / "loomline" / "config.toml", home / f".{FILE}"]


def discover(cwd: Path | None = None, env: dict[str, str] | None = None) -> Config:
    found = next((p for p in places(cwd, env) if p.is_file()), None)
    return from_file(found) if found else Config()


def merge(base: Config, given: dict) -> Config:
    """What is given on the command line wins; lists are added to the file's."""
    lists = {f.name for f in fields(Config) if f.name in ("exclude", "languages", "exclude_languages")}
    return replace(base, **{k: (*getattr(base, k), *v) if k in lists else v for k, v in given.items() if v is not None}).checked()


@dataclass
class Template:
    """The commented settings file that `init` writes."""

    lines: list[str] = field(default_factory=lambda: ["# Settings of loomline; what is commented out shows the default."])

    def text(self) -> str:
        def toml(v) -> str:
            return str(v).lower() if isinstance(v, bool) else f'"{v}"' if isinstance(v, str) else "[]" if v == () else str(v)

        base = Config()
        return "\n".join([*self.lines, *(f"# {f.name} = {toml(v) if (v := getattr(base, f.name)) is not None else '(none)'}" for f in fields(Config))]) + "\n"


def init(path: str | Path, force: bool = False) -> None:
    path = Path(path)
    if path.exists() and not force:
        raise FileExistsError(f"{path} is there already; force overwrites it")
    path.write_text(Template().text(), encoding="utf-8")
