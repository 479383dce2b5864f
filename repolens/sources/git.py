"""A data source over the history of git repositories: ``spark.read.format("githistory")``.

Options: ``path`` (a folder that all executors can read; ``|`` separates several), ``table``,
``partitions``, ``since`` (a commit of the chain; only what came after it is read). Tables:

- ``commits``: repo, chain_pos, sha, tree_oid, ts - the first-parent chain, the tip is 0
- ``raw_changes``: repo, chain_pos, old_mode, old_oid, new_mode, new_oid, path - against the first parent
- ``objects``: repo, oid, kind, size, place - trees and blobs, with their place in git's own order of its packs
- ``repo_files``: repo_path, file_pos, path - the index, in its order

``commits`` and ``raw_changes`` can also be streamed (``spark.readStream``): an offset is the tip of each repository, and a batch
has what came onto the chain since the last one. As the tip moves, a stream's ``chain_pos`` counts from the root: 0, -1, -2, ..
If history was rewritten, the stream fails and must begin anew.

Chains are read in slices of bounded length, as streams. Objects are listed once, and read by
``contents``: only those asked for, in ranges of their place, so that a task reads its packs from front to back. On
top of it ``history`` offers two tables more:

- ``tree_entries``: repo, tree_oid, name, mode, kind, child_oid
- ``blobs``: repo, oid, content
"""

from __future__ import annotations

import os
import subprocess
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMAS = {
    "commits": "repo string, chain_pos int, sha string, tree_oid string, ts timestamp",
    "raw_changes": "repo string, chain_pos int, old_mode string, old_oid string, new_mode string, new_oid string, path string",
    "objects": "repo string, oid string, kind string, size long, place long",
    "repo_files": "repo_path string, file_pos int, path string",
}
ENTRY = "repo string, tree_oid string, name string, mode string, kind string, child_oid string"
CONTENT = "repo string, oid string, content binary"
#: The most commits of a slice, and the bytes that a batch of contents gathers.
SLICE, BATCH = 2000, 4 << 20


def git(repo: str, *args: str, data: bytes | None = None) -> bytes:
    return subprocess.run(["git", "-C", repo, *args], input=data, capture_output=True, check=True).stdout


def discover(path: str) -> str:
    """The repository that holds a path: its work tree's top, or a bare repository itself."""
    top = subprocess.run(["git", "-C", path, "rev-parse", "--show-toplevel"], capture_output=True)
    if top.returncode == 0 and top.stdout.strip():
        return top.stdout.decode().strip()
    git_dir = git(path, "rev-parse", "--absolute-git-dir").decode().strip()
    return git_dir


def find_repositories(root: str, depth: int = 3) -> list[str]:
    """Repositories that lie at exactly ``depth`` folders below ``root``; unreadable folders are skipped."""
    level = [root]
    for _ in range(depth):
        below = []
        for folder in level:
            try:
                below += [e.path for e in os.scandir(folder) if e.is_dir(follow_symlinks=False)]
            except OSError:
                continue
        level = sorted(below)
    return [f for f in level if _is_top(f)]


def _is_top(folder: str) -> bool:
    try:
        return os.path.basename(folder) != ".git" and os.path.realpath(discover(folder)) == os.path.realpath(folder)
    except subprocess.CalledProcessError:
        return False


@dataclass
class Slice(InputPartition):
    repo: str
    start: int = 0
    stop: int = 0
    since: str | None = None
    tip: str = "HEAD"
    base: int = 0  # the tip's position


def _text(b: bytes) -> str:
    return b.decode("utf-8", "replace")


def _range(since: str | None, tip: str = "HEAD") -> list[str]:
    return [tip, *([f"^{since}"] if since else [])]


def _length(repo: str, since: str | None, tip: str = "HEAD") -> int:
    return int(git(repo, "rev-list", "--first-parent", "--count", *_range(since, tip)))


def _chain(s: Slice, fmt: str) -> bytes:
    return git(s.repo, "log", "--first-parent", f"--skip={s.start}", f"--max-count={s.stop - s.start}", f"--format={fmt}", *_range(s.since, s.tip))


def _commits(s: Slice) -> Iterator[tuple]:
    for i, line in enumerate(_chain(s, "%H %T %ct").decode().splitlines()):
        sha, tree, ts = line.split()
        yield s.repo, s.base + s.start + i, sha, tree, datetime.fromtimestamp(int(ts), UTC)


def _tokens(stream) -> Iterator[bytes]:
    """What lies between zero bytes, as it comes."""
    rest = b""
    while block := stream.read(1 << 16):
        *whole, rest = (rest + block).split(b"\0")
        yield from whole
    if rest:
        yield rest


def _raw_changes(s: Slice) -> Iterator[tuple]:
    # A commit and, named as its only one, its first parent; a root has none.
    pairs = [line.split()[:2] for line in _chain(s, "%H %P").decode().splitlines()]
    at = {p[0]: s.base + s.start + i for i, p in enumerate(pairs)}
    with tempfile.TemporaryFile() as asked:
        asked.write("".join(f"{' '.join(p)}\n" for p in pairs).encode())
        asked.seek(0)
        with subprocess.Popen(["git", "-C", s.repo, "diff-tree", "--stdin", "-r", "--root", "-m", "--raw", "-z", "--no-renames", "--no-abbrev"], stdin=asked, stdout=subprocess.PIPE) as p:
            pos, tokens = -1, _tokens(p.stdout)
            for t in tokens:
                if t.startswith(b":"):
                    old_mode, new_mode, old, new, _ = t[1:].decode().split(" ")
                    yield s.repo, pos, old_mode, old, new_mode, new, _text(next(tokens))
                elif t.strip():
                    pos = at[t.decode().split()[0]]
        if p.returncode:
            raise OSError(f"git diff-tree failed in {s.repo}")


def _objects(s: Slice) -> Iterator[tuple]:
    with subprocess.Popen(["git", "-C", s.repo, "cat-file", "--batch-all-objects", "--unordered", "--batch-check=%(objectname) %(objecttype) %(objectsize)"], stdout=subprocess.PIPE) as p:
        for place, line in enumerate(p.stdout):
            oid, kind, size = line.decode().split()
            if kind in ("tree", "blob"):
                yield s.repo, oid, kind, int(size), place


class _Reader:
    """Objects of a repository, one at a time: a request is written, its content is read."""

    def __init__(self, repo: str):
        self.process = subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)

    def read(self, oid: str) -> bytes | None:
        self.process.stdin.write(oid.encode() + b"\n")
        self.process.stdin.flush()
        head = self.process.stdout.readline().split()
        if len(head) < 3:
            return None
        content = self.process.stdout.read(int(head[2]))
        self.process.stdout.read(1)
        return content

    def close(self) -> None:
        self.process.stdin.close()
        self.process.wait()


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader, repo = None, None
    rows, size = ([], [], []), 0
    try:
        for b in batches:
            for own, oid in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if own != repo:
                    if reader:
                        reader.close()
                    reader, repo = _Reader(own), own
                content = reader.read(oid)
                if content is None:
                    continue
                for column, value in zip(rows, (own, oid, content), strict=True):
                    column.append(value)
                size += len(content) + 100
                if size >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2], pa.binary())], ["repo", "oid", "content"])
                    rows, size = ([], [], []), 0
        if rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2], pa.binary())], ["repo", "oid", "content"])
    finally:
        if reader:
            reader.close()


def contents(objects: DataFrame) -> DataFrame:
    """(repo, oid, content) of ``objects`` (repo, oid and, if it is known, place): these and no others are read; missing ones have no row.

    With ``place`` each task has a range of it, and reads in its order; else objects are dealt out by id.
    """
    if "place" in objects.columns:
        laid = objects.repartitionByRange("repo", "place").sortWithinPartitions("repo", "place")
    else:
        laid = objects.repartition("repo", "oid").sortWithinPartitions("repo", "oid")
    return laid.select("repo", "oid").mapInArrow(_read_batches, CONTENT)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["repo", "tree_oid", "name", "mode", "kind", "child_oid"]
    for b in batches:
        rows = [(repo, tree, *e) for repo, tree, raw in zip(*(c.to_pylist() for c in b.columns), strict=True) for e in _tree(tree, raw)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows, strict=True) if rows else [[]] * len(names))], names)


def _tree(tree: str, raw: bytes) -> Iterator[tuple[str, str, str, str]]:
    """(name, mode, kind, child's id) of the entries of a tree object."""
    at, width = 0, len(tree) // 2
    while at < len(raw):
        nul = raw.index(b"\0", at)
        mode, name = raw[at:nul].split(b" ", 1)
        mode_ = mode.decode().zfill(6)
        yield _text(name), mode_, {"040000": "tree", "160000": "commit"}.get(mode_, "blob"), raw[nul + 1 : nul + 1 + width].hex()
        at = nul + 1 + width


def _repo_files(s: Slice) -> Iterator[tuple]:
    for i, path in enumerate(x for x in git(s.repo, "ls-files", "-z").split(b"\0") if x):
        yield s.repo, i, _text(path)


READERS = {"commits": _commits, "raw_changes": _raw_changes, "objects": _objects, "repo_files": _repo_files}


def _slices(repo: str, parts: int, since: str | None, tip: str = "HEAD", base: int = 0) -> list[Slice]:
    n = _length(repo, since, tip)
    step = min(SLICE, max(1, -(-n // parts)))
    return [Slice(repo, a, min(a + step, n), since, tip, base) for a in range(0, n, step)]


class GitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.table = options["table"]
        self.repos = options["path"].split("|")
        self.parts = int(options.get("partitions", 8))
        self.since = options.get("since")

    def partitions(self) -> list[Slice]:
        out = []
        for repo in self.repos:
            if self.table in ("repo_files", "objects"):
                out.append(Slice(repo))
            else:
                out += _slices(repo, self.parts, self.since)
        return out

    def read(self, partition: Slice) -> Iterator[tuple]:
        return READERS[self.table](partition)


class GitStream(DataSourceStreamReader):
    """Tips are named in the offsets, so a batch that is run again reads the same commits, wherever the tip is by then."""

    def __init__(self, options: dict):
        self.table = options["table"]
        if self.table not in ("commits", "raw_changes"):
            raise ValueError(f"{self.table} can't be streamed")
        self.repos = options["path"].split("|")
        self.parts = int(options.get("partitions", 8))

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.repos, "")

    def latestOffset(self) -> dict:
        return {repo: tip(repo) for repo in self.repos}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        out = []
        for repo, stop in end.items():
            since = start.get(repo) or None
            if stop == (since or ""):
                continue
            if since and not (stop and follows(repo, since, stop)):
                raise ValueError(f"the history of {repo} was rewritten: {since} isn't on its chain")
            out += _slices(repo, self.parts, since, stop, 1 - _length(repo, None, stop))
        return out

    def read(self, partition: Slice) -> Iterator[tuple]:
        return READERS[self.table](partition)


class GitHistory(DataSource):
    @classmethod
    def name(cls) -> str:
        return "githistory"

    def schema(self) -> str:
        table = self.options.get("table", "")
        if table not in SCHEMAS:
            raise ValueError(f"table must be one of {', '.join(SCHEMAS)}")
        return SCHEMAS[table]

    def reader(self, schema) -> GitReader:
        return GitReader(self.options)

    def streamReader(self, schema) -> GitStream:
        return GitStream(self.options)


def history(spark: SparkSession, table: str, *repos: str, partitions: int = 8, since: str | None = None) -> DataFrame:
    """A table of one or several repositories; ``blobs`` and ``tree_entries`` read all contents or trees."""
    if table in ("blobs", "tree_entries"):
        kind = table[:4]
        read = contents(history(spark, "objects", *repos).filter(F.col("kind") == kind))
        return read if kind == "blob" else read.mapInArrow(_entries, ENTRY)
    spark.dataSource.register(GitHistory)
    out = spark.read.format("githistory").option("path", "|".join(repos)).option("table", table).option("partitions", partitions)
    return (out.option("since", since) if since else out).load()


def stream(spark: SparkSession, table: str, *repos: str, partitions: int = 8) -> DataFrame:
    """``commits`` or ``raw_changes`` as a stream of what comes onto the chains."""
    spark.dataSource.register(GitHistory)
    return spark.readStream.format("githistory").option("path", "|".join(repos)).option("table", table).option("partitions", partitions).load()


def tip(repo: str) -> str:
    """The commit at the tip; empty where there is none yet."""
    head = subprocess.run(["git", "-C", repo, "rev-parse", "--verify", "-q", "HEAD^{commit}"], capture_output=True)
    if head.returncode > 1:
        raise OSError(f"no repository: {repo}")
    return head.stdout.decode().strip()


def follows(repo: str, old: str, new: str = "HEAD") -> bool:
    """Whether a commit is one of the first-parent chain of another, by default of the tip."""
    if subprocess.run(["git", "-C", repo, "cat-file", "-e", f"{old}^{{commit}}"], capture_output=True).returncode:
        return False
    last = git(repo, "log", "--first-parent", "--format=%H %P", *_range(old, new)).decode().splitlines()[-1:]
    if not last:
        return git(repo, "rev-parse", new).decode().strip() == old
    return last[0].split()[1:2] == [old]
