"""Revisions on the driver: grammar, resolution, blobs, changed files, worktrees."""

from __future__ import annotations

import os
import subprocess
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from factloom.operators.snapshots import numstat, parse_unified


@dataclass(frozen=True)
class RevSpec:
    """``base`` and ``head``; no head is the working tree. ``compare`` says that two sides were named, be one empty."""

    base: str | None
    head: str | None
    compare: bool = False


def parse_revspec(text: str) -> RevSpec:
    """empty, ``ref``, ``a..b``, ``a..`` and ``..b``; the first ``..`` splits."""
    text = text.strip()
    if ".." not in text:
        return RevSpec(None, text or None)
    a, b = text.split("..", 1)
    return RevSpec(a or None, b or None, True)


def _git(repo: str, *args: str) -> str:
    run = subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True)
    if run.returncode:
        raise ValueError(run.stderr.strip() or f"git {args[0]} failed")
    return run.stdout


def repository_root(path: str) -> str:
    return _git(path, "rev-parse", "--show-toplevel").strip()


def resolve_sha(repo: str, ref: str) -> str:
    return _git(repo, "rev-parse", "--verify", f"{ref}^{{commit}}").strip()


def show_blob(repo: str, sha: str, path: str) -> str | None:
    """A file at a revision; null where it does not exist there."""
    try:
        return _git(repo, "show", f"{sha}:{path}")
    except ValueError:
        return None


def materialize(repo: str, sha: str, cache: str) -> str:
    """A detached worktree of ``sha`` below ``cache``, made once."""
    to = os.path.join(cache, sha[:16])
    if not os.path.isdir(os.path.join(to)) or to not in _git(repo, "worktree", "list", "--porcelain"):
        _git(repo, "worktree", "prune")
        os.makedirs(cache, exist_ok=True)
        _git(repo, "worktree", "add", "--detach", "--force", to, sha)
    return to


def changed_files(repo: str, base: str, head: str | None) -> list[str]:
    args = ["diff", "--name-only", base, *([head] if head else [])]
    return [x for x in _git(repo, *args).split("\n") if x]


def untracked_sources(repo: str) -> list[str]:
    out = _git(repo, "ls-files", "--others", "--exclude-standard").split("\n")
    return [x for x in out if x.endswith((".rs", ".ts", ".tsx")) and ".d.ts" not in x]


def diff_lines(spark: SparkSession, repo: str, base: str, head: str | None = None) -> DataFrame:
    """Changed lines of all changed files with three lines of context; unchanged files give no rows."""
    rows = [(f, _git(repo, "diff", "-U3", base, *([head] if head else []), "--", f)) for f in changed_files(repo, base, head)]
    return parse_unified(spark.createDataFrame(rows, "file string, text string"))


def changed_counts(spark: SparkSession, repo: str, base: str, head: str | None = None) -> DataFrame:
    lines = _git(repo, "diff", "--numstat", base, *([head] if head else [])).split("\n")
    return numstat(spark.createDataFrame([(x,) for x in lines if x], "line string"))


def read_source(repo: str, path: str, sha: str | None = None) -> str | None:
    """Text of a file inside the repository; paths that leave it are refused."""
    root = os.path.realpath(repo)
    full = os.path.realpath(os.path.join(root, path))
    if full != root and not full.startswith(root + os.sep):
        raise ValueError("the path leaves the workspace")
    rel = os.path.relpath(full, root)
    if sha:
        return show_blob(repo, sha, rel)
    try:
        with open(full, encoding="utf-8") as f:
            return f.read()
    except FileNotFoundError:
        return None
