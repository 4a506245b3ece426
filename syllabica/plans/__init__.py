"""Registered queries over the driver tables, each next to its SQL twin."""

import importlib
import pkgutil


def load_all() -> None:
    """Import every query module so that it registers its queries."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
