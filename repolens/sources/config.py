"""Configurations: statistics, repositories, and the catalogue of both, as JSON files."""

from __future__ import annotations

import json
import os
import re
import subprocess
from dataclasses import asdict, dataclass, field, fields
from urllib.parse import urlparse

from ..operators.measures import StatConfig

ROOT = ".repolens"


@dataclass
class RepoConfig:
    name: str
    source: str
    storage_path: str | None = None
    default_branch: str | None = None
    stats: dict[str, StatConfig] = field(default_factory=dict)


def stat_config(raw: dict, name: str | None = None) -> StatConfig:
    known = {f.name for f in fields(StatConfig)}
    out = {k: v for k, v in raw.items() if k in known and v is not None}
    if name and "name" not in out:
        out["name"] = name
    if missing := {"name", "type"} - set(out):
        raise ValueError(f"a statistic needs {', '.join(sorted(missing))}")
    return StatConfig(**out)


def read_stat(path: str) -> StatConfig:
    with open(path, encoding="utf-8") as f:
        return stat_config(json.load(f))


@dataclass
class Catalog:
    """All repositories and their statistics, kept in one file below ``root``; every change rereads it and replaces it whole."""

    root: str = ROOT
    repo_storage_location: str | None = None
    stat_storage: dict | None = None
    repos: dict[str, RepoConfig] = field(default_factory=dict)

    @property
    def location(self) -> str:
        return os.path.join(self.root, "config.json")

    @classmethod
    def load(cls, root: str = ROOT) -> Catalog:
        """The catalogue of a folder; an empty one is made at first use."""
        out = cls(root)
        if not os.path.exists(out.location):
            out.save()
            return out
        with open(out.location, encoding="utf-8") as f:
            raw = json.load(f)
        out.repo_storage_location, out.stat_storage = raw.get("repo_storage_location"), raw.get("stat_storage")
        for key, r in (raw.get("repos") or {}).items():
            if missing := {"name", "source"} - set(r):
                raise ValueError(f"repository {key!r} needs {', '.join(sorted(missing))}")
            stats = {k: stat_config(s, k) for k, s in (r.get("stats") or {}).items()}
            out.repos[key] = RepoConfig(r["name"], r["source"], r.get("storage_path"), r.get("default_branch"), stats)
        return out

    def save(self) -> None:
        os.makedirs(self.root, exist_ok=True)
        raw = {"repo_storage_location": self.repo_storage_location, "stat_storage": self.stat_storage, "repos": {k: asdict(r) for k, r in self.repos.items()}}
        beside = f"{self.location}.{os.getpid()}"
        with open(beside, "w", encoding="utf-8") as f:
            json.dump(raw, f, indent=2)
        os.replace(beside, self.location)

    def add_repo(self, repo: RepoConfig) -> None:
        fresh = self.load(self.root)
        fresh.repos[repo.name] = repo
        fresh.save()
        self.repos = fresh.repos

    def add_stat(self, repo: str, stat: StatConfig) -> None:
        stat.measurement()  # a bad one is refused here
        fresh = self.load(self.root)
        fresh.repos[repo].stats[stat.name] = stat
        fresh.save()
        self.repos = fresh.repos

    def repo(self, name: str) -> RepoConfig:
        if name not in self.repos:
            raise KeyError(f"no repository {name!r}; there are {', '.join(sorted(self.repos)) or 'none'}")
        return self.repos[name]

    def stat(self, repo: str, name: str) -> StatConfig:
        stats = self.repo(repo).stats
        if name not in stats:
            raise KeyError(f"no statistic {name!r} of {repo}; there are {', '.join(sorted(stats)) or 'none'}")
        return stats[name]

    def pairs(self, repo: str | None = None, stats: tuple[str, ...] = ()) -> list[tuple[str, str]]:
        """(repository, statistic) to run: those named, or all."""
        names = [repo] if repo else sorted(self.repos)
        return [(r, s) for r in names for s in (stats or sorted(self.repo(r).stats)) if self.stat(r, s)]

    def storage_path(self, repo: str) -> str:
        r = self.repo(repo)
        return r.storage_path or os.path.join(self.repo_storage_location or os.path.join(self.root, "repos"), r.source.replace("://", "_").replace("/", "_"), r.name)

    def stat_path(self, repo: str, stat: str) -> str:
        top = (self.stat_storage or {}).get("storage_path") or os.path.join(self.root, "stats")
        return os.path.join(top, repo, f"{stat}.csv")


@dataclass(frozen=True)
class CloneUrl:
    url: str
    domain: str
    owner: str
    repo: str


def parse_clone_url(url: str) -> CloneUrl:
    """``https://host/owner/repo(.git)``, ``git@host:owner/repo(.git)`` or ``owner/repo`` (on github.com)."""
    if m := re.fullmatch(r"[\w.-]+@([\w.-]+):(.+?)/([^/]+?)(?:\.git)?/?", url):
        return CloneUrl(url, *m.groups())
    if m := re.fullmatch(r"([\w.-]+)/([\w.-]+?)(?:\.git)?", url):
        return CloneUrl(f"https://github.com/{m[1]}/{m[2]}.git", "github.com", m[1], m[2])
    parts = urlparse(url)
    path = [p for p in parts.path.split("/") if p]
    if not parts.hostname or len(path) < 2:
        raise ValueError(f"not a repository's URL: {url}")
    return CloneUrl(url, parts.hostname, "/".join(path[:-1]), path[-1].removesuffix(".git"))


def default_branch(repo: str) -> str:
    out = subprocess.run(["git", "-C", repo, "symbolic-ref", "--short", "HEAD"], capture_output=True, check=True)
    return out.stdout.decode().strip()


def ensure_cloned(catalog: Catalog, *urls: str) -> list[str]:
    """Clone or update each repository and enter it in the catalogue; returns their names."""
    names = []
    for url in urls:
        where = parse_clone_url(url) if "/" in url and not os.path.exists(url) else CloneUrl(url, "local", "", os.path.basename(url.rstrip("/")).removesuffix(".git"))
        if where.repo not in catalog.repos:
            catalog.add_repo(RepoConfig(where.repo, where.url))
        path = catalog.storage_path(where.repo)
        if os.path.exists(path):
            subprocess.run(["git", "-C", path, "pull", "--ff-only"], check=True, capture_output=True)
        else:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            subprocess.run(["git", "clone", where.url, path], check=True, capture_output=True)
        repo = catalog.repo(where.repo)
        repo.storage_path, repo.default_branch = path, default_branch(path)
        catalog.add_repo(repo)
        names.append(where.repo)
    return names
