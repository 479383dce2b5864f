import csv
import json

import pytest

from repolens.__main__ import main
from tests import history_repo as R


def test_commands(spark, tmp_path, capsys):
    repo, root = str(tmp_path / "repo"), str(tmp_path / "root")
    R.build(repo)
    cfg = tmp_path / "s.json"
    cfg.write_text(json.dumps({"name": "pys", "type": "file_count", "params": {"pattern": "*.py"}, "granularity": "monthly"}))
    out = str(tmp_path / "out.csv")
    assert main(["--root", root, "run-one-off", str(cfg), repo, "-o", out]) == 0
    assert [r["total"] for r in csv.DictReader(open(out, newline=""))][-1] == "1"
    main(["--root", root, "clone", repo])
    main(["--root", root, "add-stat", "-r", "repo", str(cfg)])
    main(["--root", root, "config", "location"])
    capsys.readouterr()
    main(["--root", root, "config", "show"])
    assert json.loads(capsys.readouterr().out)["repo"]["stats"]["pys"]["type"] == "file_count"
    main(["--root", root, "run", "-r", "repo"])
    path = capsys.readouterr().out.strip().split("\n")[-1]
    assert len([*csv.DictReader(open(path, newline=""))]) == len([*csv.DictReader(open(out, newline=""))])
    main(["--root", root, "detect-tools", repo, "--json"])
    assert [m["name"] for m in json.loads(capsys.readouterr().out.strip().split("\n")[-1])] == ["npm"]
    with pytest.raises(SystemExit):
        main(["nothing"])
