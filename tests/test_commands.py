"""Commands and their exit codes."""

from __future__ import annotations

import json

import pytest

from lodestrand.__main__ import run


@pytest.fixture()
def folder(tmp_path):
    f = tmp_path / "config"
    (f / "corpus").mkdir(parents=True)
    files = {"agent.json": '{"model": {"id": "m"}, "allowed_operations": ["r"]}', "tools.json": '{"tools": [{"name": "a", "description": "é x"}], "hint": 1}', "eval.jsonl": '{"id": "1", "t": "one item here"}\n\t\n{"id": "2", "t": "another one"}\n', "corpus/d.md": "x\n", "corpus/e.md": "y", "prompt.txt": "p\nq"}
    for name, text in files.items():
        (f / name).write_text(text)
    return f


def test_gate_commands(spark, folder, tmp_path, capsys):
    key, saved = str(tmp_path / "key"), str(tmp_path / "receipts")
    corpus = tmp_path / "corpus.jsonl"
    corpus.write_text('{"id": "z", "t": "something else"}\n')
    assert run(["relation"]) == 0
    assert run(["issue", str(folder), saved, "--passed", "3", "--failed", "1", "--key", key, "--items", str(folder / "eval.jsonl"), "--corpus", str(corpus)]) == 0
    assert run(["verify", str(folder), saved]) == 0
    (folder / "prompt.txt").write_text("p\nz")
    assert run(["verify", str(folder), saved]) == 2
    assert run(["mutate", str(folder), "nonsense"]) == 3 and run(["manifest", str(tmp_path / "none")]) == 3
    with pytest.raises(SystemExit) as e:
        run(["nonsense"])
    assert e.value.code == 2


def test_scan_commands(spark, folder, tmp_path, capsys):
    assert run(["leakage", str(folder / "eval.jsonl"), str(folder / "eval.jsonl")]) == 1
    (tmp_path / "captures").mkdir()
    for v, d in (("1", "x"), ("2", "xy")):
        (tmp_path / "captures" / f"p@{v}.json").write_text(json.dumps({"schema": 2, "package": "p", "version": v, "tools": [{"name": "t", "description": d}], "error": None, "raw": None}))
    capsys.readouterr()
    assert run(["releases", str(tmp_path / "captures")]) == 0
    assert '"net_chars": 1' in capsys.readouterr().out
