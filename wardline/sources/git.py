"""The index of a git work tree: what is about to be committed, as a table of files.

A work tree lies on the driver's disk and its index is small, so git runs there.
"""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession

from wardline.sources import streams as T

FILES = "path string, length long, content binary"


class GitError(RuntimeError):
    """What git says when it cannot answer."""


def _git(root: str, *words: str) -> bytes:
    done = subprocess.run(["git", *words], cwd=root, capture_output=True, check=False)
    if done.returncode:
        raise GitError(done.stderr.decode(errors="replace").strip() or "not a git work tree")
    return done.stdout


def staged(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of added, copied, changed and renamed files as they are in the index, whatever the work tree holds."""
    names = [n for n in _git(root, "diff", "--cached", "--name-only", "--diff-filter=ACMR", "-z").decode().split("\0") if n]
    rows = [(name, len(body), bytearray(body)) for name in names if len(body := _git(root, "show", f":{name}")) <= T.MOST_FILE_BYTES]
    return T.scannable(spark.createDataFrame(rows, FILES))


def added_since(spark: SparkSession, root: str, ref: str) -> DataFrame:
    """(path, line) of the lines that the work tree adds to a commit."""
    text = _git(root, "diff", ref, "--unified=0", "--no-color", "--diff-filter=ACMR").decode(errors="replace")
    return T.added_lines(spark.createDataFrame([(0, i, line) for i, line in enumerate(text.split("\n"))], "diff_id int, seq int, line string"))
