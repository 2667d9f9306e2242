"""The other queries load where the text operators, or a library that they need, are missing."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("missing", ["geopanel.llm", "tiktoken", "corpus_pipeline"])
def test_queries_load_without(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; q = e.queries(); print(len([n for n in q if not n.startswith('op')]), 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, pipeline = out.stdout.split()
    assert int(n) >= 227 and pipeline == "False"
