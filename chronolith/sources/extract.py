"""Extraction of a repository into JSON lines, resumable after the last commit that was written."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass

from chronolith.functions.scalars import glob_regex
from chronolith.sources.vcs import SHA, BlobSizes, commits, git, log_command, records


class StateError(ValueError):
    """A state that cannot be resumed from."""


@dataclass(frozen=True)
class State:
    last_processed_sha: str = ""
    commit_offset: int = 0


def load_state(path: str, offset: int = -1, sha: str = "") -> State:
    """From flags (one of them at most), else from the file: JSON, or a bare offset. No file, or an empty one: the start."""
    if sha and offset >= 0:
        raise StateError("a start offset and a start sha exclude each other")
    if sha:
        if not SHA.fullmatch(sha):
            raise StateError("a start sha has 40 hexadecimal digits")
        return State(sha)
    if offset >= 0:
        return State(commit_offset=offset)
    text = ""
    if os.path.exists(path):
        with open(path, encoding="utf-8") as file:
            text = file.read().strip()
    if not text:
        return State()
    try:
        found = json.loads(text)
        state = State(commit_offset=found) if isinstance(found, int) else State(str(found.get("last_processed_sha", "")), int(found.get("commit_offset", 0)))
    except (ValueError, AttributeError, TypeError) as error:
        raise StateError(f"{path} holds no state; delete it or give a start offset") from error
    if state.commit_offset < 0:
        raise StateError(f"{path} holds a negative offset: {state.commit_offset}")
    if state.last_processed_sha and not SHA.fullmatch(state.last_processed_sha):
        raise StateError(f"{path} holds no valid sha")
    return state


def save_state(path: str, state: State) -> None:
    with open(f"{path}.new", "w", encoding="utf-8") as file:
        json.dump({k: v for k, v in asdict(state).items() if v}, file)
    os.replace(f"{path}.new", path)


def should_ignore(path: str, patterns: list[str]) -> bool:
    """A pattern fits the base name or the whole path, or names a directory above it. The same rule as scalars.ignored()."""
    base = path.rsplit("/", 1)[-1]
    for p in patterns:
        rule, stem = re.compile(glob_regex(p), re.S), p.removesuffix("*").removesuffix("/")
        if rule.match(base) or rule.match(path) or (stem and stem != p and path.startswith(f"{stem}/")):
            return True
    return False


def dev_id(email: str) -> str:
    return hashlib.sha256(email.strip().lower().encode()).hexdigest()


def known_devs(path: str) -> set[str]:
    """Lower-cased emails of the dev records of a file."""
    found = set()
    with open(path, encoding="utf-8") as lines:
        for line in lines:
            if '"dev"' in line:
                try:
                    row = json.loads(line)
                except ValueError:
                    continue
                if row.get("type") == "dev" and row.get("email"):
                    found.add(row["email"].strip().lower())
    return found


class Stopped(RuntimeError):
    """The extraction was asked to end."""


def extract(repo: str, output: str, state_file: str | None = None, *, ref: str = "HEAD", ignore: list[str] | None = None, first_parent: bool = False, messages: bool = False, mailmap: bool = False, sizes: bool = False, batch: int = 1000, offset: int = -1, sha: str = "", stopped: Callable[[], bool] | None = None) -> int:
    """Writes the records of a repository, newest commit first; returns the number of commits written.

    Resuming appends what lies behind the last commit of the state. The state is written every `batch` commits. Once
    stopped() is true, the state is written and Stopped raised.
    """
    state_file = state_file or f"{output}.state"
    state = load_state(state_file, offset, sha)
    resuming = bool(state.last_processed_sha or state.commit_offset)
    start = ref
    if state.last_processed_sha:
        if not git(repo, "rev-parse", "--verify", "--quiet", f"{state.last_processed_sha}^"):
            return 0  # the first commit of all was the last one written
        start = f"{state.last_processed_sha}^"
    devs = known_devs(output) if resuming and os.path.exists(output) else set()
    blobs = BlobSizes(repo) if sizes else None
    done, last, skip = 0, "", 0 if state.last_processed_sha else state.commit_offset
    keep = (lambda p: not should_ignore(p, ignore)) if ignore else None
    with open(output, "a" if resuming else "w", encoding="utf-8") as out:
        for at, commit in enumerate(commits(log_command(repo, start, first_parent, messages, mailmap))):
            if at < skip:
                continue
            if stopped and stopped():
                if done:
                    out.flush()
                    save_state(state_file, State(last, state.commit_offset + done))
                raise Stopped(f"stopped after {done} commits")
            for row in records(commit, keep, blobs.sizes if blobs else None):
                out.write(json.dumps(row, ensure_ascii=False) + "\n")
            for who in ("author", "committer"):
                email = commit.meta[f"{who}_email"]
                key = email.strip().lower()
                if key and key not in devs:
                    devs.add(key)
                    out.write(json.dumps({"type": "dev", "dev_id": dev_id(email), "name": commit.meta[f"{who}_name"], "email": email}, ensure_ascii=False) + "\n")
            done, last = done + 1, commit.meta["sha"]
            if done % batch == 0:
                out.flush()
                save_state(state_file, State(last, state.commit_offset + done))
    if blobs:
        blobs.close()
    if done:
        save_state(state_file, State(last, state.commit_offset + done))
    return done
