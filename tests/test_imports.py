"""Every module imports on its own in a fresh interpreter (no import cycles)."""

import pathlib
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
MODULES = sorted(
    ".".join(p.relative_to(ROOT).with_suffix("").parts).replace(".__init__", "")
    for p in (ROOT / "fleetframe").rglob("*.py")) + ["__spark_entry__"]


@pytest.mark.parametrize("module", MODULES)
def test_import_alone(module):
    r = subprocess.run([sys.executable, "-c", f"import {module}"], cwd=ROOT,
                       capture_output=True, text=True, timeout=120)
    assert r.returncode == 0, r.stderr[-2000:]
