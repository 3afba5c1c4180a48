"""History and working-tree state of a git repository as tables."""

from __future__ import annotations

import datetime
import hashlib
import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.schema import COMMIT_FILES, COMMIT_LIMIT, COMMITS


def _git(root: str, *args: str) -> str | None:
    try:
        got = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, errors="replace", check=False)
    except OSError:
        return None
    return got.stdout if got.returncode == 0 else None


def repository(path: str) -> str | None:
    """The work tree that holds ``path``, or None."""
    at = os.path.abspath(path)
    while not os.path.exists(os.path.join(at, ".git")):
        if (up := os.path.dirname(at)) == at:
            return None
        at = up
    return at


def status(root: str) -> dict[str, str]:
    """State of each file that is not clean, by absolute path."""
    top = repository(root)
    text = _git(top, "status", "--porcelain=v1", "-z", "--untracked-files=all") if top else None
    out, parts = {}, (text or "").split("\0")
    words = {"M": "modified", "A": "added", "D": "deleted", "R": "renamed", "C": "copied", "?": "untracked", "U": "unmerged"}
    i = 0
    while i < len(parts):
        if len(parts[i]) > 3:
            code = parts[i][:2].strip()[:1]
            out[os.path.join(top, parts[i][3:])] = words.get(code, code)
            i += code in "RC"
        i += 1
    return out


def head(root: str) -> tuple[str, str, datetime.datetime] | None:
    """Hash, author and date of the last commit; None before the first."""
    text = _git(root, "log", "-1", "--format=%H%x00%an%x00%ct")
    if not text or not text.strip():
        return None
    h, author, at = text.strip().split("\0")
    return h, author, datetime.datetime.fromtimestamp(int(at), datetime.timezone.utc)


def recent(spark: SparkSession, root: str, limit: int = COMMIT_LIMIT) -> DataFrame:
    """The last commits, newest first, with at most 50 files each."""
    limit = limit if limit > 0 else COMMIT_LIMIT
    text = _git(root, "log", f"-{limit}", "--no-renames", "--name-only", "--format=%x01%H%x00%an%x00%ct%x00%s%x00")
    rows = []
    for part in (text or "").split("\1")[1:]:
        h, author, at, message, files = part.split("\0", 4)
        rows.append((h, author, datetime.datetime.fromtimestamp(int(at), datetime.timezone.utc), message, [f for f in files.split("\n") if f][:COMMIT_FILES]))
    return spark.createDataFrame(rows, COMMITS)


def fingerprint(root: str) -> str:
    """Sixteen digits that change with the last commit or the state of any file."""
    first = head(root)
    lines = [f"HEAD {first[0] if first else ''}", *sorted(f"{code} {path}" for path, code in status(root).items())]
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16]


def status_table(spark: SparkSession, root: str) -> DataFrame:
    return spark.createDataFrame(sorted(status(root).items()), "path string, code string")


def stamped(documents: DataFrame, states: DataFrame, last: tuple | None) -> DataFrame:
    """Documents whose metadata name their state, ``clean`` by default, and the last commit."""
    meta = [F.lit("git_status"), F.coalesce("code", F.lit("clean"))]
    if last:
        for k, v in zip(("git_head", "git_head_author", "git_head_date"), (last[0], last[1], last[2].isoformat())):
            meta += [F.lit(k), F.lit(v)]
    joined = documents.join(states, "path", "left")
    rest = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: ~F.startswith(k, F.lit("git_")))
    return joined.withColumn("metadata", F.map_concat(rest, F.create_map(*meta))).drop("code")


def changed_only(files: DataFrame, states: DataFrame) -> DataFrame:
    return files.join(states.select("path"), "path", "left_semi")
