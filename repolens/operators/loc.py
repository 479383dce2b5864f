"""Lines of code, comment and blank, by language.

The language follows from the file's name, then its extension: two small joins. Lines are
told apart by a small helper that keeps track of block comments and quoted strings. It goes from
one mark to the next: lines without any are counted together, and no character is looked at alone.
Files with a component that starts with a dot aren't counted.

Lines of languages inside a file (scripts, styles and templates of markup, fenced code of
Markdown) are told apart by a stack of languages, and counted in rows of their own, with the
file's language as ``host``. The lines of the tags and fences are the surrounding language's, and
so is a block that ends on its first line, or whose language isn't known. The text of prose is comment.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Display name; other names; extensions; file names; line comments; block comments; nested blocks; quotes; doc strings.
LANGUAGES = [
    ("Assembly", (), ("asm", "s"), (), (";", "#"), (), False, ('"',), ()),
    ("Shell", ("Sh", "Bash"), ("sh", "bash", "zsh"), (".bashrc",), ("#",), (), False, ('"', "'"), ()),
    ("C", (), ("c", "ec", "pgc"), (), ("//",), (("/*", "*/"),), False, ('"',), ()),
    ("C Header", ("CHeader",), ("h",), (), ("//",), (("/*", "*/"),), False, ('"',), ()),
    ("C++", ("Cpp",), ("cc", "cpp", "cxx", "c++"), (), ("//",), (("/*", "*/"),), False, ('"',), ()),
    ("C++ Header", ("CppHeader",), ("hh", "hpp", "hxx"), (), ("//",), (("/*", "*/"),), False, ('"',), ()),
    ("C#", ("CSharp",), ("cs", "csx"), (), ("//",), (("/*", "*/"),), False, ('"',), ()),
    ("CMake", (), ("cmake",), ("CMakeLists.txt",), ("#",), (), False, ('"',), ()),
    ("Clojure", (), ("clj",), (), (";",), (), False, ('"',), ()),
    ("CSS", ("Css",), ("css",), (), (), (("/*", "*/"),), False, ('"', "'"), ()),
    ("D", (), ("d",), (), ("//",), (("/*", "*/"), ("/+", "+/")), True, ('"',), ()),
    ("Dart", (), ("dart",), (), ("//",), (("/*", "*/"),), False, ('"', "'"), ()),
    ("Dockerfile", (), ("dockerfile",), ("Dockerfile",), ("#",), (), False, ('"', "'"), ()),
    ("Elixir", (), ("ex", "exs"), (), ("#",), (), False, ('"',), ('"""',)),
    ("Erlang", (), ("erl", "hrl"), (), ("%",), (), False, ('"',), ()),
    ("F#", ("FSharp",), ("fs", "fsi", "fsx"), (), ("//",), (("(*", "*)"),), True, ('"',), ()),
    ("Go", (), ("go",), (), ("//",), (("/*", "*/"),), False, ('"', "`"), ()),
    ("Groovy", (), ("groovy", "gradle"), ("Jenkinsfile",), ("//",), (("/*", "*/"),), False, ('"', "'"), ()),
    ("Haskell", (), ("hs",), (), ("--",), (("{-", "-}"),), True, ('"',), ()),
    ("HTML", ("Html",), ("html", "htm"), (), (), (("<!--", "-->"),), False, ('"', "'"), ()),
    ("Java", (), ("java",), (), ("//",), (("/*", "*/"),), False, ('"',), ()),
    ("JavaScript", ("Js",), ("js", "mjs", "cjs"), (), ("//",), (("/*", "*/"),), False, ('"', "'", "`"), ()),
    ("JSON", ("Json",), ("json",), (), (), (), False, ('"',), ()),
    ("JSX", ("Jsx",), ("jsx",), (), ("//",), (("/*", "*/"),), False, ('"', "'", "`"), ()),
    ("Julia", (), ("jl",), (), ("#",), (("#=", "=#"),), True, ('"',), ('"""',)),
    ("Kotlin", (), ("kt", "kts"), (), ("//",), (("/*", "*/"),), True, ('"',), ()),
    ("LESS", ("Less",), ("less",), (), ("//",), (("/*", "*/"),), False, ('"', "'"), ()),
    ("Lua", (), ("lua",), (), ("--",), (("--[[", "]]"),), False, ('"', "'"), ()),
    ("Makefile", (), ("mk", "mak", "makefile"), ("Makefile", "makefile", "GNUmakefile"), ("#",), (), False, ('"', "'"), ()),
    ("Markdown", (), ("md", "markdown"), (), (), (("<!--", "-->"),), False, (), ()),
    ("Nix", (), ("nix",), (), ("#",), (("/*", "*/"),), False, ('"',), ()),
    ("Objective-C", ("ObjectiveC",), ("m",), (), ("//",), (("/*", "*/"),), False, ('"',), ()),
    ("OCaml", (), ("ml", "mli"), (), (), (("(*", "*)"),), True, ('"',), ()),
    ("Perl", (), ("pl", "pm"), (), ("#",), (("=pod", "=cut"),), False, ('"', "'"), ()),
    ("PHP", ("Php",), ("php",), (), ("//", "#"), (("/*", "*/"),), False, ('"', "'"), ()),
    ("PowerShell", (), ("ps1", "psm1", "psd1"), (), ("#",), (("<#", "#>"),), False, ('"', "'"), ()),
    ("Protocol Buffers", ("Protobuf",), ("proto",), (), ("//",), (("/*", "*/"),), False, ('"',), ()),
    ("Python", (), ("py", "pyw", "pyi"), (), ("#",), (), False, ('"', "'"), ('"""', "'''")),
    ("R", (), ("r",), (), ("#",), (), False, ('"', "'"), ()),
    ("Ruby", (), ("rb",), ("Rakefile", "Gemfile"), ("#",), (("=begin", "=end"),), False, ('"', "'"), ()),
    ("Rust", (), ("rs",), (), ("//",), (("/*", "*/"),), True, ('"',), ()),
    ("Sass", (), ("scss", "sass"), (), ("//",), (("/*", "*/"),), False, ('"', "'"), ()),
    ("Scala", (), ("scala", "sc"), (), ("//",), (("/*", "*/"),), True, ('"',), ()),
    ("SQL", ("Sql",), ("sql",), (), ("--",), (("/*", "*/"),), False, ("'",), ()),
    ("Svelte", (), ("svelte",), (), ("//",), (("/*", "*/"), ("<!--", "-->")), False, ('"', "'"), ()),
    ("Swift", (), ("swift",), (), ("//",), (("/*", "*/"),), True, ('"',), ()),
    ("Terraform", ("Hcl", "HCL"), ("tf", "hcl", "tfvars"), (), ("#", "//"), (("/*", "*/"),), False, ('"',), ()),
    ("Plain Text", ("Text",), ("txt",), (), (), (), False, (), ()),
    ("TOML", ("Toml",), ("toml",), (), ("#",), (), False, ('"', "'"), ()),
    ("TSX", ("Tsx",), ("tsx",), (), ("//",), (("/*", "*/"),), False, ('"', "'", "`"), ()),
    ("TypeScript", (), ("ts", "mts", "cts"), (), ("//",), (("/*", "*/"),), False, ('"', "'", "`"), ()),
    ("Vue", (), ("vue",), (), ("//",), (("/*", "*/"), ("<!--", "-->")), False, ('"', "'", "`"), ()),
    ("XML", ("Xml",), ("xml", "xsd", "xsl"), (), (), (("<!--", "-->"),), False, ('"', "'"), ()),
    ("YAML", ("Yaml",), ("yaml", "yml"), (), ("#",), (), False, ('"', "'"), ()),
    ("Zig", (), ("zig",), (), ("//",), (), False, ('"',), ()),
]
BY_NAME = {x[0]: x for x in LANGUAGES}
#: Languages of prose; of markup with blocks of other languages; those that a block has if its tag names none.
PROSE = ("Markdown", "Plain Text")
MARKUP = ("HTML", "Vue", "Svelte")
BLOCKS = {"script": "JavaScript", "style": "CSS", "template": "HTML"}
HOSTS = ("Markdown", *MARKUP)
_TAG = re.compile(r"<(script|style|template)(?=[\s>])([^>]*)>", re.I)
_NAMED = re.compile(r"""(?:^|\s)(?:lang|type)\s*=\s*["']?(?:(?:text|application)/)?(?:x-)?(?:[\w.-]+\+)?([\w.#+-]+)""", re.I)
_COMMENT = re.compile(r"<!--.*?(?:-->|$)")
_FENCE = re.compile(r"(`{3,}(?=[^`]*$)|~{3,})\s*\{?\.?([\w#+.-]*)")


def language_name(name: str) -> str:
    """The display name of a language by any of its names, whatever their case."""
    for x in LANGUAGES:
        if name.lower() in (n.lower() for n in (x[0], *x[1])):
            return x[0]
    raise ValueError(f"unknown language: {name}")


@lru_cache(4096)
def language_of_tag(tag: str) -> str | None:
    """The display name of a language by any of its names or extensions; None if it isn't known."""
    tag = tag.lower()
    return next((x[0] for x in LANGUAGES if tag in (n.lower() for n in (x[0], *x[1], *x[2]))), None)


@dataclass
class Lines:
    """What is open within the lines of one language: ends of block comments, a quoted string."""

    language: str
    ends: tuple[str, ...] = ()
    opener: str = ""
    quote: str = ""

    def plain(self) -> bool:
        return not self.ends and not self.quote

    def kind(self, s: str) -> int:
        """0 if the line is blank, 1 if it has code, 2 if it is comment alone. ``s`` has no space around it."""
        if not s:
            return 0
        if self.language in PROSE:
            return 2
        nested, marks = BY_NAME[self.language][6], _marks(self.language)
        has_code, i = False, 0
        while i < len(s):
            if self.ends:
                m = _inside(self.ends[-1], self.opener if nested else "").search(s, i)
                if m and m[0] == self.ends[-1]:
                    self.ends = self.ends[:-1]
                elif m:
                    self.ends = (*self.ends, self.ends[-1])
            elif self.quote:
                m = _quoted(self.quote).search(s, i)
                if m and m[0] == self.quote:
                    self.quote = ""
            else:
                m = marks.search(s, i)
                has_code |= not s[i : m.start() if m else len(s)].isspace() and (not m or m.start() > i)
                if m and m["doc"]:
                    self.ends, self.opener = (m[0],), ""
                    has_code |= m.start() > 0  # a string after code on its line is no doc string
                elif m and m["block"]:
                    self.opener = m[0]
                    self.ends = (next(end for start, end in BY_NAME[self.language][5] if start == m[0]),)
                elif m and m["line"]:
                    break
                elif m:
                    self.quote, has_code = m[0], True
            i = m.end() if m else len(s)
        if self.quote != "`":
            self.quote = ""  # plain strings end with their line
        return 1 if has_code else 2


def _any(marks: Iterable[str]) -> str:
    return "|".join(map(re.escape, marks)) or "(?!)"


@cache
def _marks(language: str) -> re.Pattern:
    """What of a line of code opens a doc string, a block comment, a line comment or a quoted string."""
    _, _, _, _, line, blocks, _, quotes, docs = BY_NAME[language]
    return re.compile(f"(?P<doc>{_any(docs)})|(?P<block>{_any(b[0] for b in blocks)})|(?P<line>{_any(line)})|(?:{_any(quotes)})")


@cache
def _inside(end: str, opener: str) -> re.Pattern:
    return re.compile(_any([end, opener] if opener else [end]))


@cache
def _quoted(quote: str) -> re.Pattern:
    return re.compile(r"\\.?|" + re.escape(quote))


_OPENS = re.compile("<(?i:script|style|template)")


@cache
def _notable(language: str, inside: bool) -> tuple[str | re.Pattern, ...]:
    """What a line has that isn't plain code or prose, or may open a block or close one that it is ``inside``.

    A quoted string that ends with its line matters only if the line has one of the others.
    """
    _, _, _, _, line, blocks, _, quotes, docs = BY_NAME[language]
    marks = [] if language in PROSE else [*docs, *(b[0] for b in blocks), *line, *(q for q in quotes if q == "`")]
    if inside or language == "Markdown":
        marks += ["```", "~~~"]
    if inside:
        marks.append("</")
    return tuple(marks) + ((_OPENS,) if language in MARKUP else ())


def _next(text: str, at: int, end: int, marks: tuple[str | re.Pattern, ...], found: dict) -> int:
    """The place of the first of some marks from ``at`` on, ``end`` if there is none. ``found`` keeps each mark's own, so that a text is searched once for it."""
    least = end
    for x in marks:
        if (p := found.get(x, -1)) < at:
            if isinstance(x, str):
                p = text.find(x, at, end)
            else:
                p = m.start() if (m := x.search(text, at, end)) else -1
            found[x] = p = end if p < 0 else p
        least = min(least, p)
    return least


@dataclass
class Block:
    """A language of the stack. ``end`` is what closes it; within ``raw`` text only a fence around it is looked for as well."""

    lines: Lines
    end: re.Pattern | None = None
    raw: bool = False
    fence: bool = False


def _opened(s: str, top: Block) -> Block | None:
    """The block that a line opens. One that also ends there is none."""
    host = top.lines.language
    if top.raw or not top.lines.plain():
        return None
    if host == "Markdown" and (m := _FENCE.match(s)):
        end = re.compile(f"{m[1][0]}{{{len(m[1])},}}$")
        inner = language_of_tag(m[2])
        return Block(Lines(inner) if inner else top.lines, end, raw=inner not in HOSTS, fence=True)
    if host in MARKUP:
        s = _COMMENT.sub("", s)
        for m in reversed([m for m in _TAG.finditer(s) if not m[2].endswith("/")]):
            name = m[1].lower()
            end = re.compile(f"</{name}\\s*>", re.I)
            if end.search(s, m.end()):
                continue
            named = _NAMED.search(m[2])
            inner = language_of_tag(named[1]) if named and named[1].lower() != "module" else BLOCKS[name]
            return Block(Lines(inner) if inner else top.lines, end, raw=inner not in MARKUP)
    return None


def _closed(s: str, stack: list[Block]) -> tuple[int, str] | None:
    """The place in the stack of the innermost block that a line closes, and what of the line comes after."""
    raw = False
    for k in range(len(stack) - 1, 0, -1):
        if (stack[k].fence or not raw) and (m := stack[k].end.match(s) if stack[k].fence else stack[k].end.search(s)):
            return k, s[m.end() :]
        raw |= stack[k].raw
    return None


def classify_all(text: str, language: str) -> dict[str | None, tuple[int, int, int]]:
    """(blanks, code, comments) of a text's own lines (None), and of those of each language inside it."""
    counts: dict[str | None, list[int]] = {None: [0, 0, 0]}
    own = Lines(language)
    stack = [Block(own)]
    at, end, found = 0, len(text) - text.endswith("\n"), {}
    while at <= end and text:
        lines = stack[-1].lines
        if lines.plain():
            # Lines up to the next one with a mark are blank or not, and are counted at once.
            mark = _next(text, at, end, _notable(lines.language, len(stack) > 1), found)
            stop = text.rfind("\n", at, mark) + 1 or at if mark < end else end + 1
            if stop > at:
                rows = text[at : stop - 1].split("\n")
                full = sum(map(bool, map(str.strip, rows)))
                of = counts.setdefault(None if lines is own else lines.language, [0, 0, 0])
                of[0] += len(rows) - full
                of[2 if lines.language in PROSE else 1] += full
                at = stop
                continue
        stop = text.find("\n", at, end)
        stop = end if stop < 0 else stop
        s = text[at:stop].strip()
        at = stop + 1
        left = s
        if closed := _closed(s, stack):
            del stack[closed[0] :]
            left = closed[1]
        lines = stack[-1].lines
        opened = _opened(left, stack[-1]) if left else None
        counts.setdefault(None if lines is own else lines.language, [0, 0, 0])[lines.kind(s)] += 1
        if opened:
            lines.ends, lines.quote = (), ""  # what follows the tag on its line is the block's
            stack.append(opened)
    return {k: tuple(v) for k, v in counts.items()}


def classify(text: str, language: str) -> tuple[int, int, int]:
    """(blanks, code, comments) of a text's own lines. A line with both code and comment is code; doc strings are comments."""
    return classify_all(text, language)[None]


def languages(spark, wanted: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(name, language) and (extension, language): of the wanted languages, all if none is named."""
    names = {language_name(w) for w in wanted} or set(BY_NAME)
    kept = [x for x in LANGUAGES if x[0] in names]
    by_file = [(f, x[0]) for x in kept for f in x[3]]
    by_extension = [(e, x[0]) for x in kept for e in x[2]]
    return spark.createDataFrame(by_file, "name string, by_name string"), spark.createDataFrame(by_extension, "extension string, by_extension string")


def with_language(files: DataFrame, wanted: tuple[str, ...] = ()) -> DataFrame:
    """``files`` of a known language, with ``language``; those with a dot-component are left out."""
    by_file, by_extension = languages(files.sparkSession, wanted)
    name = F.element_at(F.split("path", "/"), -1)
    shown = files.filter(~(F.startswith("path", F.lit(".")) | F.contains("path", F.lit("/.")))).withColumn("name", name)
    shown = shown.withColumn("extension", F.when(F.contains("name", F.lit(".")), F.lower(F.element_at(F.split("name", r"\."), -1))))
    out = shown.join(F.broadcast(by_file), "name", "left").join(F.broadcast(by_extension), "extension", "left")
    return out.withColumn("language", F.coalesce("by_name", "by_extension")).filter("language is not null").drop("name", "extension", "by_name", "by_extension")


COUNTED = "path string, oid string, language string, host string, blanks long, code long, comments long"


def count_lines(files: DataFrame, wanted: tuple[str, ...] = (), embedded: bool = False) -> DataFrame:
    """COUNTED of ``files`` (path, oid, content): a row for the file's own lines, and one for each language inside it, with its ``host``.

    ``wanted`` are languages of files; with ``embedded`` they are languages of lines, wherever these are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, got = [], []
            for i, (c, n) in enumerate(zip(b.column(3).to_pylist(), b.column(2).to_pylist(), strict=True)):
                for inner, counts in classify_all((c or b"").decode("utf-8", "replace"), n).items():
                    at.append(i)
                    got.append((inner or n, inner and n, *counts))
            columns = [pa.array([g[i] for g in got], pa.string() if i < 2 else pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*(x.take(pa.array(at, pa.int64())) for x in b.columns[:2]), *columns], ["path", "oid", "language", "host", "blanks", "code", "comments"])

    of_files = (*wanted, *HOSTS) if wanted and embedded else wanted
    rows = with_language(files, of_files).select("path", "oid", "language", "content").mapInArrow(run, COUNTED)
    return rows.filter(F.col("language").isin([language_name(w) for w in wanted])) if wanted and embedded else rows
