"""Measurements of files, and how they are summed per commit.

A measurement looks at each distinct (path, oid) once. It yields rows (path, oid, key,
value); a file that can't be measured has no row, and a value of zero counts as none. Those
that look at paths alone never read contents.
"""

from __future__ import annotations

import os
import re
import subprocess
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json_query import number as json_number
from ..functions.json_query import object_counts
from ..functions.lines import content_matching_lines
from ..functions.patterns import glob_matches
from ..functions.values import NUMBER
from .loc import count_lines
from .reshape import top_n


@dataclass(frozen=True)
class Measurement:
    """``contents``: whether files are read. ``whole``: whether values are whole numbers. ``always``: a key that each commit has."""

    contents = True
    whole = True
    always: str | None = None

    def measure(self, files: DataFrame) -> DataFrame:
        """(path, oid, key, value) of ``files``: path, oid and, if contents are read, content."""
        raise NotImplementedError

    def finish(self, totals: DataFrame) -> DataFrame:
        """What is shown of (chain_pos, key, total)."""
        return totals


def _keyed(files: DataFrame, key: str, value: Column) -> DataFrame:
    return files.select("path", "oid", F.lit(key).alias("key"), value.alias("value")).filter("value is not null and value <> 0")


@dataclass(frozen=True)
class Grep(Measurement):
    """Lines in which a pattern is found; a file with a matching line that isn't UTF-8 has no value."""

    pattern: str = "todo"
    always: str = "total"

    def measure(self, files: DataFrame) -> DataFrame:
        return _keyed(files, "total", content_matching_lines(F.col("content"), self.pattern))


@dataclass(frozen=True)
class FileCount(Measurement):
    """Files whose whole path matches a glob."""

    pattern: str = "index.html"
    always: str = "total"
    contents = False

    def measure(self, files: DataFrame) -> DataFrame:
        hit = glob_matches(F.col("path"), self.pattern) & ~F.endswith("path", F.lit("/"))
        return _keyed(files, "total", hit.cast("long"))


@dataclass(frozen=True)
class Loc(Measurement):
    """Code lines by language; ``languages`` by any of their names, all if empty; the ``topn`` largest of each commit.

    Lines of other languages inside a file count for none, or, with ``embedded``, for their own language.
    """

    languages: tuple[str, ...] = ()
    topn: int | None = None
    embedded: bool = False

    def measure(self, files: DataFrame) -> DataFrame:
        out = count_lines(files, self.languages, self.embedded).filter("blanks + code + comments > 0")
        if self.embedded:
            return out.groupBy("path", "oid", F.col("language").alias("key")).agg(F.sum("code").alias("value"))
        return out.filter("host is null").select("path", "oid", F.col("language").alias("key"), F.col("code").alias("value"))

    def finish(self, totals: DataFrame) -> DataFrame:
        return totals if self.topn is None else top_n(totals, self.topn, ("chain_pos",), "total", "key")


@dataclass(frozen=True)
class JsonNumber(Measurement):
    """The number that a query finds in each ``.json`` file."""

    query: str = "."
    always: str = "jq_result"
    whole = False

    def measure(self, files: DataFrame) -> DataFrame:
        return _keyed(files.filter(F.endswith("path", F.lit(".json"))), "jq_result", json_number(F.col("content"), self.query))


@dataclass(frozen=True)
class JsonObject(Measurement):
    """The non-negative whole numbers of the object that a query finds in each ``.json`` file, summed by key."""

    query: str = "."

    def measure(self, files: DataFrame) -> DataFrame:
        pairs = files.filter(F.endswith("path", F.lit(".json"))).select("path", "oid", F.explode(object_counts(F.col("content"), self.query)).alias("k", "value"))
        return pairs.select("path", "oid", F.concat(F.lit(f"jq_obj_query_{self.query}_"), "k").alias("key"), "value")


def run_command(command: list[str], content: bytes, timeout: float) -> float | None:
    """The first word of a command's output as a number; the content is a file, its last argument. None if it fails."""
    with tempfile.NamedTemporaryFile() as f:
        f.write(content)
        f.flush()
        try:
            done = subprocess.run([*command, f.name], capture_output=True, timeout=timeout, check=True)
            word = done.stdout.decode().split()[0]
            return float(word) if re.fullmatch(NUMBER, word, re.ASCII) else None
        except (OSError, subprocess.SubprocessError, UnicodeDecodeError, ValueError, IndexError):
            return None


@dataclass(frozen=True)
class FileScript(Measurement):
    """The number that a command prints for a file. It runs once for each distinct content, whatever its paths."""

    command: str = "echo 1"
    args: tuple[str, ...] = ()
    timeout: float = 60.0
    always: str = "result"
    whole = False

    def measure(self, files: DataFrame) -> DataFrame:
        command = [*self.command.split(), *self.args]
        timeout = self.timeout

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = [run_command(command, c or b"", timeout) for c in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64())], ["oid", "value"])

        once = files.select("oid", "content").dropDuplicates(["oid"]).mapInArrow(run, "oid string, value double")
        return files.select("path", "oid").join(once, "oid").select("path", "oid", F.lit("result").alias("key"), "value").filter("value is not null and value <> 0")


@dataclass(frozen=True)
class Script(Measurement):
    """A command over a checkout of each whole commit: it prints a number or a flat JSON object of numbers.

    It has no files; ``plans.engine`` runs it once for each sampled commit.
    """

    command: str = "echo 1"
    timeout: float = 600.0
    whole = False

    def at(self, repo: str, sha: str) -> dict[str, float]:
        import json

        with tempfile.TemporaryDirectory() as top:
            archive = subprocess.run(["git", "-C", repo, "archive", sha], capture_output=True, check=True).stdout
            subprocess.run(["tar", "-x", "-C", top], input=archive, check=True)
            try:
                out = subprocess.run(self.command, shell=True, cwd=top, capture_output=True, timeout=self.timeout, check=True, env=os.environ | {"COMMIT": sha}).stdout.decode().strip()
                got = json.loads(out)
            except (OSError, subprocess.SubprocessError, ValueError):
                return {}
        pairs = got.items() if isinstance(got, dict) else [("result", got)]
        return {str(k): float(v) for k, v in pairs if isinstance(v, (int, float))}


KINDS = {"tokei": Loc, "loc": Loc, "grep": Grep, "regex_count": Grep, "file_count": FileCount, "jq": JsonNumber, "jq_object": JsonObject, "file_script": FileScript, "script": Script}
#: Names of parameters in a config, where they aren't those of the measurement.
_PARAMS = {"script": {"script": "command"}}


@dataclass(frozen=True)
class StatConfig:
    """What to measure: a kind, its parameters, and which files, period and range."""

    name: str
    type: str
    description: str = ""
    params: dict = field(default_factory=dict)
    path_in_repo: str | None = None
    start: str | None = None
    end: str | None = None
    granularity: str | dict | None = None

    def measurement(self) -> Measurement:
        if self.type not in KINDS:
            raise ValueError(f"unknown type {self.type!r}: one of {', '.join(KINDS)}")
        names = _PARAMS.get(self.type, {})
        kind = KINDS[self.type]
        known = {k for k in kind.__dataclass_fields__ if k != "always"}
        given = {names.get(k, k): tuple(v) if isinstance(v, list) else v for k, v in (self.params or {}).items()}
        if unknown := set(given) - known:
            raise ValueError(f"unknown parameters of {self.type}: {', '.join(sorted(unknown))}")
        for k, v in given.items():
            if isinstance(v, tuple) and not all(isinstance(x, str) for x in v):
                raise ValueError(f"{k} must be a list of strings")
        return kind(**given)
