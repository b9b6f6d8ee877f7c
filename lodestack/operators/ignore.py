"""Ignore rules: compiled on the driver, applied to path columns. A few rules become one expression of Spark's regular expressions; more of them
a tree by the directories of their files, which Arrow batches of paths are led through."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import decode_path
from ..schemas import ContractError, ScanPolicy

#: Up to as many rules are one expression, which repeats all of them for each directory of a path. Both ways give the same rows.
FEW_RULES = 16


@dataclass(frozen=True)
class Rule:
    """base: directory of the rule's file; name_only: the pattern is for a last component at any depth."""

    base: str
    pattern: str
    negated: bool
    directories: bool
    name_only: bool


#: Tokens of a pattern: escape, double star with slash, double star, star, question mark, class, bracket, other.
_TOKEN = re.compile(r"\\(?P<escape>.)|(?P<deep>\*\*/)|(?P<all>\*\*)|(?P<star>\*)|(?P<one>\?)|\[(?P<class>[^\]]+)\]|(?P<other>.)", re.DOTALL)


def _quoted(c: str) -> str:
    return c if c.isalnum() or c == "_" or ord(c) > 127 else "\\" + c


def glob_regex(pattern: str) -> str:
    """A pattern as a regular expression that Java and Python read alike, without anchors."""
    out = []
    for m in _TOKEN.finditer(pattern):
        kind = m.lastgroup
        if kind == "class":
            inside = m["class"]
            lead = "^" if inside[0] == "!" else ""
            inside = inside[1:] if lead else inside
            if not inside:  # [!] has nothing to exclude
                out.append(r"\[" + _quoted("!") + _quoted("]"))
                continue
            # A backslash in a class is a character of it; a leading caret makes a class of both.
            inside = ("\\" + inside if inside[0] == "^" and not lead else inside).replace("\\", "\\\\")
            out.append("[" + lead + inside.replace("[", "\\[").replace("&&", "&\\&") + "]")
        else:
            out.append({"deep": "(?:.*/)?", "all": ".*", "star": "[^/]*", "one": "[^/]"}.get(kind) or _quoted(m[kind]))
    return "".join(out)


def parse_rule(base: str, line: str) -> Rule | None:
    """None for blanks and comments. Unescaped blanks at the end go; a backslash keeps #, ! or a blank."""
    stripped = line.rstrip(" ")
    slashes = len(stripped) - len(stripped.rstrip("\\"))
    text = stripped + (" " if slashes % 2 and len(stripped) < len(line) else "")
    if not text or text[0] == "#":
        return None
    text = text[1:] if text.startswith("\\#") else text
    negated = text.startswith("!")
    text = text[1:] if negated or text.startswith("\\!") else text
    directories = text.endswith("/") and not text.endswith("\\/")
    text = text[:-1] if directories else text
    anchored = text.startswith("/")
    text = text[1:] if anchored else text
    if not text:
        return None
    try:
        compiled = glob_regex(text)
        re.compile(compiled)
    except re.error as e:
        raise ContractError(f"invalid ignore pattern {line!r}") from e
    return Rule(base, compiled, negated, directories, not anchored and "/" not in text)


def compile_rules(sources: dict[str, str]) -> list[Rule]:
    """Rules of all ignore files (path to text), in the order that they apply: by depth, path and line."""
    out = []
    for path in sorted(sources, key=lambda p: (p.count("/"), p)):
        base = path.rpartition("/")[0]
        out += [r for line in sources[path].splitlines() if (r := parse_rule(base, line))]
    return out


def _matches(rule: Rule, path: Column, is_dir: Column) -> Column:
    inside = path if not rule.base else F.when(path.startswith(rule.base + "/"), F.substring(path, F.lit(len(rule.base) + 2), F.length(path)))
    target = F.substring_index(inside, "/", -1) if rule.name_only else inside
    found = F.coalesce(target.rlike(rf"(?s)\A(?:{rule.pattern})\z"), F.lit(False))
    return found & is_dir if rule.directories else found


def decision(rules: list[Rule], path: Column, is_dir: Column) -> Column:
    """Whether the last matching rule ignores the path itself."""
    return reduce(lambda so_far, r: F.when(_matches(r, path, is_dir), F.lit(not r.negated)).otherwise(so_far), rules, F.lit(False))


def is_ignored(rules: list[Rule], path: Column, is_dir: Column | None = None) -> Column:
    """A path is ignored by its own decision, or if any directory above it is: no rule below brings it back. A null path is not."""
    if len(rules) > FEW_RULES:
        return ignored_by_tree(rules, path, is_dir)
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    above = F.when(F.size(parts) > 1, above).otherwise(F.array().cast("array<string>"))
    return F.exists(above, lambda p: decision(rules, p, F.lit(True))) | decision(rules, path, F.lit(False) if is_dir is None else is_dir)


class _Matcher:
    """The rules of one directory for one kind of target. The last that matches counts: a literal by its text, patterns by one alternation in
    reverse order, of which a match names the first branch. Compiled when first used."""

    def __init__(self):
        self.literals: dict[str, tuple[int, bool]] = {}
        self.patterns: list[tuple[int, bool, str]] = []
        self.compiled: re.Pattern | None = None

    def add(self, n: int, rule: Rule) -> None:
        plain = re.sub(r"\\(.)", r"\1", rule.pattern, flags=re.DOTALL)
        if glob_literal(rule.pattern):
            self.literals[plain] = (n, not rule.negated)
        else:
            self.patterns.append((n, not rule.negated, rule.pattern))
            self.compiled = None

    def last(self, target: str) -> tuple[int, bool]:
        found = self.literals.get(target, (-1, False))
        if self.patterns:
            if self.compiled is None:
                self.compiled = re.compile("|".join(f"({p})" for _, _, p in reversed(self.patterns)), re.DOTALL)
            m = self.compiled.fullmatch(target)
            if m:
                found = max(found, self.patterns[-m.lastindex][:2])
        return found


def glob_literal(pattern: str) -> bool:
    """Whether a pattern of glob_regex() stands for one text."""
    return re.fullmatch(r"(?:\\.|[^\\\[\].*?()^])*", pattern, re.DOTALL) is not None


class RuleTree:
    """Rules by the directory of their ignore file. A path is led through its directories from the top; each adds its own rules to those that hold
    above, so that rules of other directories cost nothing. A directory's state is held for the paths that follow, 65,536 of them at most."""

    STATES = 1 << 16

    def __init__(self, rules: list[Rule] = ()):
        self.size = 0
        self.bases: dict[str, dict[tuple[bool, bool], _Matcher]] = {}
        self.states: dict[str, tuple] = {}
        self.add(rules)

    def add(self, rules: list[Rule]) -> None:
        """More rules, which come after those that it has."""
        for r in rules:
            at = self.bases.setdefault(r.base, {})
            for is_dir in (True,) if r.directories else (True, False):
                at.setdefault((r.name_only, is_dir), _Matcher()).add(self.size, r)
            self.size += 1
        self.states.clear()

    def decides(self, active: tuple[str, ...], path: str, is_dir: bool) -> bool:
        name, found = path.rpartition("/")[2], (-1, False)
        for base in active:
            inside = path[len(base) + 1 :] if base else path
            for (name_only, for_dir), matcher in self.bases[base].items():
                if for_dir == is_dir:
                    found = max(found, matcher.last(name if name_only else inside))
        return found[1]

    def _state(self, path: str) -> tuple[str, ...] | None:
        """Directories with rules above a path; None if one of the directories is ignored."""
        end = path.rfind("/")
        if end >= 0 and path[:end] in self.states:
            return self.states[path[:end]]
        active = ("",) if "" in self.bases else ()
        end = path.find("/")
        while end >= 0 and active is not None:
            at = path[:end]
            if at in self.states:
                active = self.states[at]
            else:
                active = None if self.decides(active, at, True) else (*active, at) if at and at in self.bases else active
                if len(self.states) >= self.STATES:
                    self.states.clear()
                self.states[at] = active
            end = path.find("/", end + 1)
        return active

    def ignored(self, path: str, is_dir: bool) -> bool:
        active = self._state(path)
        return active is None or self.decides(active, path, is_dir)


def ignored_by_tree(rules: list[Rule], path: Column, is_dir: Column | None = None) -> Column:
    """is_ignored() for any number of rules, in Arrow batches."""
    tree = RuleTree(rules)

    @F.arrow_udf("boolean")
    def ignored(paths: pa.Array, kinds: pa.Array) -> pa.Array:
        return pa.array([p is not None and tree.ignored(p, bool(d)) for p, d in zip(paths.to_pylist(), kinds.to_pylist())], pa.bool_())

    return ignored(path, F.lit(False) if is_dir is None else is_dir)


def is_excluded(path: Column, policy: ScanPolicy = ScanPolicy()) -> Column:
    """A component of the path has one of the excluded names."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, policy.excluded_names)))


def select_paths(files: DataFrame, sources: dict[str, str], policy: ScanPolicy = ScanPolicy(), name: str = ".gitignore") -> DataFrame:
    """Rows that a scan keeps. An active ignore file stays even if a rule ignores it; under an ignored directory it is not active."""
    rules: list[Rule] = []
    active: list[str] = []
    tree = RuleTree()
    for path in sorted(sources, key=lambda p: (p.count("/"), p)):
        above = decode_path(path).rpartition("/")[0]
        if not above or not tree.ignored(above, True):
            active.append(path)
            found = compile_rules({path: sources[path]})
            rules += found
            tree.add(found)
    kept = ~is_ignored(rules, F.col("path")) | F.col("path").isin(active) if active else ~is_ignored(rules, F.col("path"))
    return files.where(~is_excluded(F.col("path"), policy) & kept)
