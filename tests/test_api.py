"""The engine end to end: a changed function, its callers and its test."""

import json

import pytest

from weftline import __main__ as cli
from weftline import api

FILES = {
    "src/core.py": "import os\n\n\ndef compute(value, limit):\n    if value > limit:\n        return limit\n    return value\n\n\ndef unrelated():\n    return 1\n",
    "src/use.py": "from src.core import compute\n\n\ndef outer(rows):\n    total = 0\n    for row in rows:\n        total += compute(row, 9)\n    return total\n",
    "tests/test_core.py": "from src.core import compute\n\n\ndef test_compute():\n    assert compute(3, 2) == 2\n",
    "src/far.py": "def nothing_here():\n    return 'x'\n",
}
DIFF = "diff --git a/src/core.py b/src/core.py\n--- a/src/core.py\n+++ b/src/core.py\n@@ -4,3 +4,3 @@\n def compute(value, limit):\n-    if value >= limit:\n+    if value > limit:\n         return limit\n"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(list(FILES.items()), "path string, content string")


@pytest.mark.parametrize("scoring", ["ego", "pit"])
def test_context_holds_the_core_and_its_callers(corpus, scoring):
    doc = json.loads(api.build_context(corpus, DIFF, scoring=scoring))
    assert doc["schema"] == "context.v1" and doc["changed_files"] == ["src/core.py"] and doc["fragment_count"] == len(doc["fragments"])
    symbols = [f.get("symbol") for f in doc["fragments"]]
    # The lexical scorers see only what the changed lines name.
    assert symbols[0] == "compute" and (scoring != "ego" or {"outer", "test_compute"} & set(symbols)) and doc["coverage"]["used_tokens"] <= 8000


def test_budgets_locate_and_impact(corpus):
    state = api.scored_state(corpus, DIFF)
    assert api.select(state, 0).count() == 0 and api.select(state, -1).count() >= api.select(state, 130).count() >= 1
    assert {r["file"] for r in api.select(state, full=True).join(state.fragments, "id").select("file").collect()} == {"src/core.py"}
    located = json.loads(api.build_locate(corpus, DIFF, budget=110))
    assert located["schema"] == "locate.v1" and located["item_count"] == len(located["items"]) and all(i["confidence"] < 1 for i in located["items"]) and located["overflow"]["total"] >= located["item_count"]
    impact = json.loads(api.build_impact(corpus, DIFF))
    assert {(c["name"], c["file"]) for c in impact["callers"]} >= {("compute", "src/use.py"), ("compute", "tests/test_core.py")} and impact["tested_by"] == [{"file": "tests/test_core.py", "hops": 1}] and impact["changed_files"] == ["src/core.py"]
    assert {c["file"] for c in json.loads(api.build_impact(corpus, symbol="compute"))["callers"]} == {"src/use.py", "tests/test_core.py"}
    with pytest.raises(ValueError):
        api.scored_state(corpus, DIFF, "other")


def test_an_empty_change(corpus):
    doc = json.loads(api.build_context(corpus, ""))
    assert doc["fragments"] == [] and doc["changed_files"] == []


def test_command_line(spark, tmp_path, capsys):
    root = tmp_path / "p"
    for p, c in FILES.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(c)
    (tmp_path / "d.diff").write_text(DIFF)
    out = tmp_path / "o.json"
    assert cli.main(["context", str(root), "--diff", str(tmp_path / "d.diff"), "-o", str(out)]) == cli.OK and json.loads(out.read_text())["fragments"]
    assert cli.main(["tree", str(root)]) == cli.OK and "  core.py" in capsys.readouterr().out
    assert cli.main(["context", str(root)]) == cli.USAGE and cli.main(["nonsense"]) == cli.USAGE and cli.main(["context", str(root), "--diff", str(tmp_path / "absent")]) == cli.FAILED
