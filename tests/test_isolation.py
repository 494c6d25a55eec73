import re
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_the_llm_package():
    for p in [*(ROOT / "tidemark").rglob("*.py"), *(ROOT / "tests").glob("*.py"), ROOT / "bench.py"]:
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(?:from|import)\s+tidemark\.llm", p.read_text(), re.MULTILINE), p


def test_no_machine_local_cut():
    for p in (ROOT / "tidemark").rglob("*.py"):
        assert "localCheckpoint" not in p.read_text(), p
