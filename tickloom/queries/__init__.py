"""All registered queries; importing the modules fills the registry."""
import importlib

from .registry import ORACLES, QUERIES

MODULES = ["roll_ups", "normalizing", "merging", "technical", "checking", "measuring", "forecasting", "live"]

for _module in MODULES:
    importlib.import_module(f"{__name__}.{_module}")

__all__ = ["ORACLES", "QUERIES"]
