import pytest

from glyphloom.functions.guard_rules import check_source, shown
from glyphloom.operators import guard


def kinds(path, text):
    return [k for _, _, k, _ in check_source(path, text)]


@pytest.mark.parametrize(
    "path, text, expected",
    [
        ("src/a.py", "from typing import Any\n", ["typing-import-any"]),
        ("src/a.py", "x: object = None\n", ["object-in-annotation"]),
        ("src/a.py", "def f(a: object): ...\n", ["object-in-annotation"]),
        ("src/a.py", "async def f() -> object: ...\n", ["object-in-annotation"]),
        ("src/a.py", "x = 1  # type: ignore\n", ["type-ignore"]),
        ("src/a.py", "print('hello')\n", ["print-usage"]),
        ("scripts/a.py", "print('hello')\n", []),
        ("src/a.py", "try:\n    x\nexcept ValueError:\n    pass\n", ["silent-except-body", "except-without-log-or-raise"]),
        ("tests/a.py", "try:\n    x\nexcept ValueError:\n    pass\n", []),
        ("src/a.py", "try:\n    x\nexcept Exception:\n    logger.error('x')\n    raise\n", []),
        ("src/a.py", "try:\n    x\nexcept Exception:\n    raise\n", ["broad-except-requires-log-and-raise"]),
        ("src/a.py", "try:\n    x\nexcept ValueError:\n    log.info('x')\n", []),
        ("src/a.py", "import contextlib\nwith contextlib.suppress(KeyError):\n    x\n", ["suppress-usage"]),
        ("/p/tests/test_a.py", "def test_x():\n    assert len(x) > 0\n", ["weak-assertion-len-zero"]),
        ("/p/tests/test_a.py", "def test_x():\n    assert len(x) == 5\n", []),
        ("/p/tests/test_a.py", "def test_x():\n    assert 0 < len(x) < 10\n", []),
        ("/p/tests/test_a.py", "def test_x():\n    with patch('a'), patch('b'), patch('c'), m.patch('d'):\n        pass\n", ["excessive-mocking"]),
        ("/p/tests/test_a.py", "def test_x():\n    client.train()\n", []),
        ("/p/tests/test_a.py", "def test_x():\n    loss.backward()\n    opt.step()\n    assert loss_after < loss_start\n", ["ml-optimizer-no-weight-check"]),
    ],
)
def test_rules(path, text, expected):
    assert kinds(path, text) == expected


def test_broken_source_is_an_error():
    with pytest.raises(RuntimeError, match="Failed to parse"):
        kinds("src/a.py", "def f(")


def test_byte_order_mark_and_long_lines():
    assert kinds("src/a.py", "﻿x = 1\n") == []
    assert shown("a" * 81) == "a" * 80 + "..."


def test_report_lists_every_rule(spark):
    found = guard.violations(spark.createDataFrame([("src/a.py", "print(1)\n")], "path string, source string"))
    rows = {r["rule"]: r["violations"] for r in guard.report(found).collect()}
    assert len(rows) == 7 and rows["logging"] == 1 and sum(rows.values()) == 1


def test_command(spark, tmp_path, capsys):
    root = tmp_path / "p"
    (root / "src").mkdir(parents=True)
    assert guard.run_guards(spark, str(root)) == 1
    (root / "pyproject.toml").touch()
    (root / "src" / "a.py").write_text("x = 1\n")
    assert guard.run_guards(spark, str(root)) == 0
    (root / "src" / "b.py").write_text("print(x)\n")
    assert guard.run_guards(spark, str(root)) == 2
    assert "src/b.py:1: print-usage" in capsys.readouterr().err
