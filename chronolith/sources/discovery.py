"""Finding repositories below folders, and running extraction over all of them."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
import re
import threading
import time
from collections import Counter
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from chronolith.functions.scalars import glob_regex
from chronolith.sources.extract import extract
from chronolith.sources.vcs import default_branch

RESERVED = {"index"}


@dataclass(frozen=True)
class Rule:
    pattern: str
    negated: bool = False
    directories_only: bool = False


def _glob(pattern: str, text: str) -> bool:
    return bool(re.match(glob_regex(pattern), text, re.S))


class Matcher:
    """Ignore rules: the last one that fits decides, `!` takes a path back, a trailing slash is for directories."""

    def __init__(self, lines: Iterable[str] = ()) -> None:
        self.rules: list[Rule] = []
        for line in map(str.strip, lines):
            if line and not line.startswith("#"):
                negated = line.startswith("!")
                body = line[negated:]
                if pattern := body.removesuffix("/"):
                    self.rules.append(Rule(pattern, negated, body.endswith("/")))

    @classmethod
    def load(cls, path: str) -> Matcher:
        with open(path, encoding="utf-8") as lines:
            return cls(lines)

    @staticmethod
    def _fits(pattern: str, path: str) -> bool:
        pattern = pattern.removeprefix("**/")
        base = path.rsplit("/", 1)[-1]
        if _glob(pattern, base) or _glob(pattern, path) or pattern == base:
            return True
        if not any(c in pattern for c in "*?[") and pattern in path.split("/"):
            return True
        stem = pattern.removesuffix("*").removesuffix("/")
        return bool(stem) and stem != pattern and (path == stem or path.startswith(f"{stem}/"))

    def match(self, path: str, is_dir: bool) -> bool:
        decided = False
        for rule in self.rules:
            if (is_dir or not rule.directories_only) and self._fits(rule.pattern, path):
                decided = not rule.negated
        return decided

    def could_reinclude(self, directory: str) -> bool:
        """True if a negated rule may fit something below an ignored directory."""
        above = directory.split("/")
        for rule in (r for r in self.rules if r.negated):
            parts = rule.pattern.split("/")
            if len(parts) == 1 or parts[0] == "**":
                return True
            if len(parts) > len(above) and all(_glob(p, d) for p, d in zip(parts, above, strict=False)):
                return True
        return False


@dataclass
class Repository:
    path: str
    relative: str
    slug: str = ""


def is_repository(path: str) -> bool:
    """A working tree (its .git a folder, or a file that points to one; no link) or a bare repository."""
    entry = os.path.join(path, ".git")
    if os.path.isdir(entry) and not os.path.islink(entry):
        return True
    if os.path.isfile(entry) and not os.path.islink(entry):
        with open(entry, "rb") as file:
            if file.read(8) == b"gitdir: ":
                return True
    return all(os.path.exists(os.path.join(path, x)) for x in ("HEAD", "objects", "refs"))


def discover(roots: list[str], matcher: Matcher | None = None, max_depth: int = 0) -> list[Repository]:
    """Repositories below the roots, by slug; nothing inside a repository is searched."""
    matcher = matcher or Matcher()
    found: dict[str, Repository] = {}
    for root in roots:
        top = os.path.realpath(root)
        if not os.path.isdir(top):
            raise NotADirectoryError(top)
        for path, folders, _ in os.walk(top):
            relative = os.path.relpath(path, top).replace(os.sep, "/")
            deep = 0 if relative == "." else relative.count("/") + 1
            folders.sort()
            if max_depth and deep >= max_depth:
                folders[:] = [] if deep > max_depth else folders
            if max_depth and deep > max_depth:
                continue
            if relative != "." and matcher.match(relative, True):
                if not matcher.could_reinclude(relative):
                    folders.clear()
                continue
            if is_repository(path):
                folders.clear()
                found.setdefault(path, Repository(path, relative))
    repos = list(found.values())
    assign_slugs(repos)
    return sorted(repos, key=lambda r: r.slug)


def assign_slugs(repos: list[Repository]) -> None:
    """Unique names, case aside; a name that several share, or that is reserved, gets a piece of its path's hash."""
    bases = [re.sub(r"[^A-Za-z0-9._-]", "_", os.path.basename(r.path)) or "repo" for r in repos]
    uses = Counter(b.lower() for b in bases)
    digests = [hashlib.sha1(r.path.encode()).hexdigest() for r in repos]
    for size in range(6, 41, 2):
        slugs = [f"{b}-{d[:size]}" if uses[b.lower()] > 1 or b.lower() in RESERVED else b for b, d in zip(bases, digests, strict=True)]
        if len({s.lower() for s in slugs}) == len(slugs):
            for repo, slug in zip(repos, slugs, strict=True):
                repo.slug = slug
            return
    raise ValueError("paths with one hash")


@dataclass
class Entry:
    slug: str
    path: str
    status: str = "pending"  # ok, failed, skipped (not begun when the scan was stopped)
    output: str = ""
    error: str = ""
    commits: int = 0
    seconds: float = 0.0
    branch: str = ""
    state_file: str = ""


@dataclass
class Manifest:
    roots: list[str]
    repositories: list[Entry] = field(default_factory=list)
    generated_at: str = ""

    def write(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as file:
            json.dump(asdict(self), file, indent=2)


def workers() -> int:
    return min(16, max(2, os.cpu_count() or 2))


def scan(roots: list[str], output: str, matcher: Matcher | None = None, max_depth: int = 0, parallel: int = 0, run: Callable[..., int] = extract, stop: threading.Event | None = None, timeout: float = 0.0, **options: object) -> Manifest:
    """Extracts every repository below the roots into `output`; one that fails does not stop the others.

    When `stop` is set, or `timeout` seconds have gone by, running extractions end at their next commit and are failed,
    their state kept for a later run; repositories that have not begun are skipped.
    """
    os.makedirs(output, exist_ok=True)
    found = discover(roots, matcher, max_depth)
    manifest = Manifest(list(roots), [Entry(r.slug, r.path, output=os.path.join(output, f"{r.slug}.jsonl"), state_file=os.path.join(output, f"{r.slug}.state")) for r in found])
    stop, limit = stop or threading.Event(), time.monotonic() + timeout if timeout > 0 else None
    stopped = lambda: stop.is_set() or (limit is not None and time.monotonic() > limit)

    def one(entry: Entry) -> None:
        if stopped():
            entry.status = "skipped"
            return
        began = time.monotonic()
        try:
            own = options if run is not extract else {**options, "stopped": stopped, "ref": (branch := default_branch(entry.path))}
            entry.branch = branch if run is extract else ""
            entry.commits = run(entry.path, entry.output, entry.state_file, **own)
            entry.status = "ok"
        except Exception as error:  # noqa: BLE001  whatever one repository raises is its own failure
            entry.status, entry.error = "failed", str(error)
        entry.seconds = round(time.monotonic() - began, 3)

    try:
        with ThreadPoolExecutor(parallel or workers()) as pool:
            try:
                list(pool.map(one, manifest.repositories))
            except KeyboardInterrupt:
                stop.set()
                raise
    finally:
        manifest.generated_at = dt.datetime.now(dt.UTC).isoformat(timespec="seconds")
        manifest.write(os.path.join(output, "manifest.json"))
    if manifest.repositories and all(e.status == "failed" for e in manifest.repositories):
        raise RuntimeError("every repository failed: " + "; ".join(e.error for e in manifest.repositories[:3]))
    return manifest
