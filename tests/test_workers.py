"""Tasks run where the package is not on the path."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from tests.conftest import make_session
from jurisindex.operators.anchors import anchor_blocks
from jurisindex.sources.captures import RESPONSE_SCHEMA
rows = [(1, "plena", 2024, "u", 200, "<p>a <a href='b'>c</a></p>")]
print("found", anchor_blocks(make_session().createDataFrame(rows, RESPONSE_SCHEMA)).first().bloque)
"""


def test_block_reader_needs_no_installed_package(tmp_path):
    repo = str(Path(__file__).resolve().parents[1])
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(repo=repo)], cwd=tmp_path, capture_output=True, text=True, timeout=300
    )
    assert "found ac" in done.stdout, done.stderr[-2000:]
