"""A small git repository with the awkward cases, and plain-Python answers for each of its commits."""

from __future__ import annotations

import os
import subprocess


def git(repo, *args, data=None, env=None):
    return subprocess.run(["git", "-C", str(repo), *args], input=data, capture_output=True, check=True, env=os.environ | (env or {})).stdout


def build(repo) -> None:
    os.makedirs(repo, exist_ok=True)
    git(repo, "init", "-q", "-b", "main")
    git(repo, "config", "user.email", "a@example.org")
    git(repo, "config", "user.name", "A")

    def write(path, content):
        full = os.path.join(repo, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as f:
            f.write(content)

    def commit(when, message="c"):
        git(repo, "add", "-A")
        git(repo, "commit", "-q", "--allow-empty", "-m", message, env={"GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when})

    write("a.py", b"# todo one\nx = 1\n\n'''doc\nstring'''\ny = 2  # todo two\n")
    write("dir/sub/b.c", b"/* c\n todo */\nint x; // todo\nint y;\n")
    write("package.json", b'{"dependencies": {"a": 1, "b": 2}, "n": 1.5}')
    write("empty.txt", b"")
    commit("2022-01-01T10:00:00 +0000")
    write("copy/a.py", b"# todo one\nx = 1\n\n'''doc\nstring'''\ny = 2  # todo two\n")
    write("crlf.txt", b"todo\r\nother\r\n\r\ntodo")
    write("run.sh", b"echo todo\n")
    os.chmod(os.path.join(repo, "run.sh"), 0o755)
    commit("2022-01-01T20:00:00 +0000")
    write("bad.txt", b"todo \xff\nfine\n")
    write("half.txt", b"todo\nnot \xff\n")
    os.symlink("a.py", os.path.join(repo, "link.py"))
    write("sp ace/n\nl/é.txt", b"todo\n")
    commit("2022-01-03T09:00:00 +0000")
    git(repo, "checkout", "-q", "-b", "side")
    write("side.txt", b"todo\ntodo\n")
    write("broken.json", b"{not json")
    write("zero.json", b"")
    commit("2021-12-01T00:00:00 +0000", "back-dated")
    git(repo, "checkout", "-q", "main")
    write("dir/sub/c.rs", b"// todo\nfn main() {} /* todo /* in */ */\n")
    commit("2022-01-03T23:30:00 -0500")
    when = "2022-02-10T00:00:00 +0000"
    git(repo, "merge", "-q", "--no-ff", "side", "-m", "merge", env={"GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when})
    git(repo, "mv", "a.py", "moved.py")
    write("package.json", b'{"dependencies": {"a": 1, "b": 2, "c": 0.5}, "n": 0.25}')
    commit("2021-06-01T00:00:00 +0000", "back-dated in the chain")
    os.chmod(os.path.join(repo, "half.txt"), 0o755)
    commit("2022-02-11T00:00:00 +0000")
    git(repo, "rm", "-q", "-r", "copy")
    commit("2022-03-01T01:00:00 +0000")


def chain(repo):
    """(sha, epoch seconds) from the tip."""
    out = git(repo, "log", "--first-parent", "--format=%H %ct").decode().split("\n")
    return [(x.split()[0], int(x.split()[1])) for x in out if x]


def snapshot(repo, sha):
    """path -> content of the plain files of a commit."""
    out = {}
    for row in git(repo, "ls-tree", "-r", "-z", sha).split(b"\0"):
        if row:
            meta, path = row.split(b"\t", 1)
            mode, _, oid = meta.decode().split()
            if mode == "100644":
                out[path.decode("utf-8", "replace")] = git(repo, "cat-file", "blob", oid)
    return out
