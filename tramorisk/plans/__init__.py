"""Job compositions and the query catalogue."""

from __future__ import annotations

import importlib
import pkgutil


def load_catalog() -> None:
    """Import every catalogue module, which registers its queries."""
    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("catalog_"):
            importlib.import_module(f"{__name__}.{module.name}")
