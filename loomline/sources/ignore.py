"""Ignore files and exclude globs: which paths a walk leaves out.

A pattern without a slash inside matches names at any depth; with one, paths from the ignore file's own folder; a final
slash restricts it to folders; `!` takes back; the last match of a file decides. Of one kind of file the nearest folder's
says first, up to the root of the file system (the git kinds up to the root of the repository); `.ignore` goes before
`.gitignore`, that before `.git/info/exclude`, and the user's global file comes last.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path

#: Names and globs of generated files.
GENERATED = (
    "Cargo.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "bun.lock", "deno.lock", "go.sum",
    "Gemfile.lock", "composer.lock", "poetry.lock", "Pipfile.lock", "uv.lock", "mix.lock", "pubspec.lock", "flake.lock",
    "Podfile.lock", "packages.lock.json", "shrinkwrap.json", "cabal.project.freeze", "cpanfile.snapshot",
    "gradle.lockfile", ".terraform.lock.hcl", "*.min.js", "*.min.mjs", "*.min.css",
)


def glob_regex(glob: str) -> str:
    """A path glob as a regular expression: ** crosses folders, * and ? and [] do not, {} holds alternatives."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out += "(?!/)[" + ("^" + body[1:] if body[0] in "!^" else body) + "]"
            i = end
        elif c == "{" and "}" in glob[i:]:
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    return out


@dataclass(frozen=True)
class Rule:
    pattern: re.Pattern
    folders_only: bool
    keeps: bool

    @classmethod
    def parse(cls, line: str) -> Rule | None:
        line = line.rstrip("\r\n")
        line = re.sub(r"(?<!\\)[ \t]+$", "", line)
        if not line or line.startswith("#"):
            return None
        keeps = line.startswith("!")
        line = line[1:] if keeps else line
        folders = line.endswith("/")
        line = line.rstrip("/") if folders else line
        if not line:
            return None
        anywhere = "/" not in line
        body = glob_regex(line.lstrip("/"))
        return cls(re.compile(("(?:.*/)?" if anywhere else "") + body + r"\Z", re.DOTALL), folders, keeps)


class Rules:
    """Rules of one folder; paths are relative to it, with slashes."""

    def __init__(self, lines: Iterable[str]):
        self.rules = [r for r in map(Rule.parse, lines) if r]

    def decide(self, path: str, folder: bool) -> bool | None:
        """True: leave out; False: keep; None: no rule says."""
        for r in reversed(self.rules):
            if (folder or not r.folders_only) and r.pattern.match(path):
                return not r.keeps
        return None


def excludes(patterns: Iterable[str], generated: bool = True) -> Rules:
    """User globs, all of which exclude (a leading ! is dropped), and those of generated files."""
    return Rules([p.lstrip("!") for p in patterns] + (list(GENERATED) if generated else []))


_NONE = Rules(())


def _lines(path: str) -> Rules:
    try:
        return Rules(Path(path).read_text("utf-8", "replace").split("\n"))
    except OSError:
        return _NONE


def global_file(env: dict[str, str] | None = None) -> str | None:
    """The user's global git ignore file: core.excludesFile of their git settings, else git/ignore in their settings folder."""
    env = os.environ if env is None else env
    home = env.get("HOME", "")
    own = env.get("XDG_CONFIG_HOME") or (f"{home}/.config" if home else "")
    for settings in (f"{home}/.gitconfig", f"{own}/git/config"):
        section = ""
        try:
            text = Path(settings).read_text("utf-8", "replace")
        except OSError:
            continue
        for line in text.split("\n"):
            if m := re.match(r"\s*\[\s*([^\]\s]+)", line):
                section = m[1].lower()
            elif section == "core" and (m := re.match(r'\s*excludesfile\s*=\s*"?([^"#;\n]+?)"?\s*(?:[#;].*)?$', line, re.IGNORECASE)):
                return f"{home}{m[1][1:]}" if m[1].startswith("~/") else m[1]
    return f"{own}/git/ignore" if own else None


class IgnoreFiles:
    """What the ignore files in a path's folders, those above the walk's root among them, say of it; each is read once."""

    def __init__(self, globally: str | None = None):
        self.folders: dict[str, tuple[Rules, Rules, Rules, bool]] = {}
        self.globally = _lines(globally) if globally else _NONE

    def _of(self, folder: str) -> tuple[Rules, Rules, Rules, bool]:
        found = self.folders.get(folder)
        if found is None:
            found = (_lines(f"{folder}/.ignore"), _lines(f"{folder}/.gitignore"), _lines(f"{folder}/.git/info/exclude"), os.path.exists(f"{folder}/.git"))
            self.folders[folder] = found
        return found

    def left_out(self, path: str, is_folder: bool, root: str) -> bool:
        """path and root are absolute."""
        said: list[bool | None] = [None, None, None]
        folder, in_git = os.path.dirname(path), False
        while True:
            *rules, has_git = self._of(folder.rstrip("/"))
            for kind, r in enumerate(rules):
                if said[kind] is None and r.rules and not (kind and in_git):
                    said[kind] = r.decide(path[len(folder.rstrip("/")) + 1 :], is_folder)
            in_git |= has_git
            above = os.path.dirname(folder)
            if above == folder or said[0] is not None:
                break
            folder = above
        said.append(self.globally.decide(path[len(root.rstrip("/")) + 1 :], is_folder))
        return next((x for x in said if x is not None), False)
