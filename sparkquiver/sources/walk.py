"""Source trees: walking, reading, and the files that version control reports as changed."""

from __future__ import annotations

import os
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquiver.functions.paths import LANGUAGES

EXCLUDED = frozenset({".git", "node_modules", "target", "dist", "build", "vendor", "deps", "tests", "__pycache__", ".venv", "venv"})
MAX_BYTES = 5_000_000


def collect_files(root: str | Path, extensions: set[str] | None = None, exclude: frozenset[str] = EXCLUDED) -> list[str]:
    """Paths below root, relative and sorted: no links, no hidden names, no excluded directories."""
    want, out = extensions or set(LANGUAGES), []
    for at, dirs, names in os.walk(root, followlinks=False):
        dirs[:] = sorted(d for d in dirs if not d.startswith(".") and d not in exclude and not os.path.islink(os.path.join(at, d)))
        for n in names:
            full = os.path.join(at, n)
            if not n.startswith(".") and not os.path.islink(full) and n.rpartition(".")[2] in want and "." in n:
                out.append(os.path.relpath(full, root))
    return sorted(out)


def worktree_names(root: str | Path) -> set[str]:
    """Directories below root that are other work trees of its repository."""
    base, out = Path(root).resolve(), set()
    meta = base / ".git" / "worktrees"
    if meta.is_dir():
        for w in meta.iterdir():
            try:
                at = Path((w / "gitdir").read_text().strip()).parent
            except OSError:
                continue
            if base in at.parents:
                out.add(at.name)
    return out


def read_files(spark: SparkSession, root: str | Path, paths: list[str] | None = None) -> DataFrame:
    """(path, size_bytes, mtime, text): the paths go to executors, which read the files; text is null over MAX_BYTES or where it isn't
    UTF-8."""
    root = str(root)
    paths = collect_files(root, exclude=EXCLUDED | worktree_names(root)) if paths is None else paths
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    if len(paths) > 64:
        rows = rows.repartition(min(len(paths) // 16, 4096))

    def read(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for p in pdf["path"]:
                full = os.path.join(root, p)
                try:
                    st = os.stat(full)
                    text = None if st.st_size > MAX_BYTES else Path(full).read_bytes().decode("utf-8")
                    out.append((p, st.st_size, st.st_mtime_ns, text))
                except (OSError, UnicodeDecodeError):
                    out.append((p, -1, 0, None))
            yield pd.DataFrame(out, columns=["path", "size_bytes", "mtime", "text"])

    return rows.mapInPandas(read, "path string, size_bytes bigint, mtime bigint, text string")


def parse_porcelain(text: str) -> list[str]:
    """Paths of `git status --porcelain`; a rename counts as its new path."""
    out = set()
    for line in text.splitlines():
        if len(line) > 3:
            out.add(line[3:].rpartition(" -> ")[2].strip().strip('"'))
    return sorted(out)


def changed_paths(root: str | Path, base: str | None = None) -> list[str]:
    """Paths that differ from a base revision, or from the last commit where none is given."""
    args = ["diff", "--name-only", base] if base else ["status", "--porcelain"]
    out = subprocess.run(["git", "-C", str(root), *args], capture_output=True, text=True, check=True).stdout
    return sorted({x for x in out.splitlines() if x}) if base else parse_porcelain(out)


def with_language(files: DataFrame) -> DataFrame:
    from sparkquiver.functions.paths import language_of

    return files.withColumn("language", language_of(F.col("path")))
