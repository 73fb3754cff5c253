"""Ignore rules like those of version control: the last rule that matches a path decides."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is ignored unless a later rule brings it back.
DEFAULTS = (".git/", ".svn/", ".hg/", "build/", "dist/", "out/", "node_modules/", "__pycache__/", ".venv/", "venv/", "*.o", "*.obj", "*.a", "*.so", "*.exe", "*.d")


def glob_pattern(glob: str, anchored: bool) -> str:
    """A pattern for a path with slashes: `**` crosses folders, `*` and `?` don't, and what lies beneath matches too."""
    out = []
    for part in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", glob):
        out.append({"**/": "(?:.+/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or re.sub(r"([.^$+(){}|\[\]\\])", r"\\\1", part))
    return ("^" if anchored else "(?:^|/)") + "".join(out) + "(?:/.*)?$"


@dataclass(frozen=True)
class IgnoreRule:
    glob: str
    negated: bool
    folders_only: bool
    anchored: bool

    @classmethod
    def parse(cls, line: str) -> IgnoreRule | None:
        """Blank lines and comments are no rules; a slash before the end anchors."""
        text = line.strip()
        if not text or text.startswith("#"):
            return None
        negated, text = text.startswith("!"), text.lstrip("!").strip()
        folders_only, text = text.endswith("/"), text.rstrip("/")
        anchored, text = "/" in text and not text.startswith("**/"), text.lstrip("/")
        return cls(text, negated, folders_only, anchored) if text else None

    @property
    def pattern(self) -> str:
        return glob_pattern(self.glob, self.anchored)

    @property
    def exact(self) -> str:
        return self.pattern[: -len("(?:/.*)?$")] + "$"

    def matches(self, path: str, is_folder: bool) -> bool:
        if not re.search(self.pattern, path):
            return False
        # a rule for folders doesn't match a file of that name, but what lies beneath
        return not (self.folders_only and not is_folder and re.search(self.exact, path) and not self._beneath(path))

    def _beneath(self, path: str) -> bool:
        parent = path.rpartition("/")[0]
        return bool(parent) and bool(re.search(self.pattern, parent))


class IgnoreRules:
    """Rules in order: defaults, given ones, then those of ignore files."""

    def __init__(self, patterns=(), use_defaults: bool = True):
        self.rules = [r for line in (*(DEFAULTS if use_defaults else ()), *patterns) if (r := IgnoreRule.parse(line))]

    def add_text(self, text: str) -> None:
        self.rules += [r for line in text.splitlines() if (r := IgnoreRule.parse(line))]

    def add_file(self, path: str) -> None:
        """A missing file adds nothing."""
        try:
            with open(path, encoding="utf-8", errors="replace") as file:
                self.add_text(file.read())
        except OSError:
            return

    def ignores(self, path: str, is_folder: bool = False) -> bool:
        path, out = path.replace("\\", "/").removeprefix("./").strip("/"), False
        for rule in self.rules:
            if rule.matches(path, is_folder):
                out = not rule.negated
        return out

    def prunes(self, folder: str) -> bool:
        """Whether a folder need not be entered: it's ignored, and no negation could match beneath it."""
        return self.ignores(folder, True) and not any(r.negated and self._reaches(r, folder.strip("/")) for r in self.rules)

    @staticmethod
    def _reaches(rule: IgnoreRule, folder: str) -> bool:
        if not rule.anchored or "**" in rule.glob:
            return True
        wanted, have = rule.glob.split("/"), folder.split("/")
        return all(re.search(glob_pattern(w, True).replace("(?:/.*)?$", "$"), h) for w, h in zip(wanted, have))

    def column(self, path: Column) -> Column:
        """The same for a column of file paths, as one expression."""
        plain = F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(?:\./)+", ""), r"^/+|/+$", "")
        out = F.lit(False)
        for rule in self.rules:
            found = plain.rlike(rule.pattern)
            if rule.folders_only:
                found &= ~plain.rlike(rule.exact) | F.regexp_replace(plain, r"/?[^/]*$", "").rlike(rule.pattern)
            out = F.when(found, F.lit(not rule.negated)).otherwise(out)
        return out
