"""Globs as regular expressions of Java and RE2, and path predicates built from them."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import BINARY_EXT, DEFAULT_EXCLUDES, GENERATED, NON_SOURCE_DIR, NON_SOURCE_EXT, SENSITIVE_GLOBS, SENSITIVE_NAMES, TEST_PATH

NEVER = "[^\\s\\S]"


def norm_globs(globs: str | Iterable[str] | None, default: Iterable[str] = ("**/*",)) -> list[str]:
    """None: the default; a string: its comma-separated parts."""
    if globs is None:
        return list(default)
    parts = globs.split(",") if isinstance(globs, str) else globs
    return [p.strip() for p in parts if p.strip()]


def glob_body(glob: str) -> str:
    """Without anchors. A double star with a slash is any number of folders, one without crosses slashes."""
    pieces = re.findall(r"\*\*/|\*\*|\*|\?|\[!?\]?[^\]]*\]|[\s\S]", glob.removeprefix("/"))
    named = {"**/": "(?:[^/]+/)*", "**": ".*", "*": "[^/]*", "?": "[^/]"}

    def one(p: str) -> str:
        if p in named:
            return named[p]
        if len(p) > 2 and p[0] == "[":
            inner = p[1:-1].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            return f"[^{inner[1:]}]" if inner[0] == "!" else f"[{inner}]" if inner[0] != "^" else f"[\\{inner}]"
        return re.sub(r"([^\w/])", r"\\\1", p) if p.isascii() else p

    return "".join(map(one, pieces))


def compile_glob(glob: str) -> str:
    """A folder's own path matches its `folder/**`."""
    body = glob_body(glob)
    return body[: -len("/.*")] + "(?:/.*)?" if body.endswith("/.*") else body


def paths_regex(globs: Iterable[str]) -> str:
    """One regular expression for all: a glob without a slash also matches the last name alone."""
    parts = [("(?:.*/)?" if "/" not in g else "") + compile_glob(g) for g in globs]
    return rf"^(?s:{'|'.join(parts)})\z" if parts else NEVER


def matches(path: Column, globs: Iterable[str]) -> Column:
    return path.rlike(paths_regex(globs))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-cased, with the dot; a name that only begins with dots has none."""
    return F.lower(F.regexp_extract(base_name(path), r"[^.].*?(\.[^.]*)$", 1))


def is_sensitive(path: Column) -> Column:
    return base_name(path).isin(*SENSITIVE_NAMES) | matches(path, SENSITIVE_GLOBS)


def is_binary(path: Column) -> Column:
    return suffix(path).isin(*BINARY_EXT)


def ends_regex(endings: Iterable[str]) -> str:
    return "(?:" + "|".join(re.sub(r"\.", r"\\.", e) for e in endings) + r")\z"


def is_source(path: Column) -> Column:
    return ~F.lower(path).rlike(ends_regex(NON_SOURCE_EXT)) & ~path.rlike(NON_SOURCE_DIR) & ~F.lower(path).rlike(GENERATED)


def is_test(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def all_excludes(exclude: str | Iterable[str] | None) -> list[str]:
    return [*DEFAULT_EXCLUDES, *norm_globs(exclude, ())]


def segments(glob: str) -> list[str]:
    parts = glob.removeprefix("/").split("/")
    return parts if len(parts) > 1 else ["**", *parts]


def reachable(folder: str, glob: str) -> bool:
    """Whether a path below the folder can match the glob: states are places in its segments."""
    want = segments(glob)

    def closed(states: set[int]) -> set[int]:
        for i in sorted(states):
            while i < len(want) and want[i] == "**":
                i += 1
                states = states | {i}
        return states

    states = closed({0})
    for part in folder.split("/"):
        states = closed({i if want[i] == "**" else i + 1 for i in states if i < len(want) and (want[i] == "**" or re.fullmatch(glob_body(want[i]), part))})
    return any(i < len(want) for i in states)


def literal_roots(globs: Iterable[str]) -> list[str] | None:
    """Folders that hold everything the globs can match, or None for the whole tree: what a listing may be limited to."""
    roots = set()
    for g in globs:
        parts = segments(g)
        fixed = []
        for p in parts[:-1]:
            if re.search(r"[*?\[]", p):
                break
            fixed.append(p)
        if not fixed:
            return None
        roots.add("/".join(fixed))
    return sorted(r for r in roots if not any(r != o and f"{r}/".startswith(f"{o}/") for o in roots))
