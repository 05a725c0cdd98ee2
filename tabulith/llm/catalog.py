"""Imports every operator module, so that its query is registered."""

from importlib import import_module

from .registry import ORACLES, QUERIES

MODULES = ("language", "forest", "decontam", "packing", "topk", "urls", "quality", "licences", "lines", "passages", "alignment", "chat", "whitening")

for _name in MODULES:
    import_module(f"{__package__}.{_name}")

__all__ = ["ORACLES", "QUERIES"]
