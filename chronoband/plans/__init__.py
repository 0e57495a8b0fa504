"""Registered queries; importing the package registers all of them."""

from importlib import import_module
from pathlib import Path

for _p in sorted(Path(__file__).parent.glob("[a-z]*.py")):
    import_module(f"{__name__}.{_p.stem}")
