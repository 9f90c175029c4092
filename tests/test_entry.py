import subprocess
import sys
from pathlib import Path

from hexafact import catalogue

ROOT = Path(__file__).resolve().parent.parent


def test_queries_without_the_subpackage():
    """Where it, or what it depends on, cannot be imported, the other queries stay."""
    code = "import sys; sys.modules['{0}'] = None; import __spark_entry__ as e; print(*sorted(e.queries()))"
    for blocked in ("zstandard", "hexafact.llm", "corpus_pipeline"):
        out = subprocess.run([sys.executable, "-c", code.format(blocked)], cwd=ROOT, capture_output=True, text=True, check=True)
        assert out.stdout.split() == sorted(catalogue.queries()), blocked
