"""Decoding, calibration and querying of neural recordings on Spark."""

from __future__ import annotations

import importlib

#: Public functions and their modules; imported on first use, so that tasks load only what they run.
_HOME = {"get_channel": "catalog", "get_event": "catalog", "get_nev": "catalog", "get_nsp": "catalog", "get_nsx": "catalog", "import_nsp": "catalog", "get_specification": "specs", "read_bci2000": "bci2000", "read_bci2000_header": "bci2000"}
__all__ = ["get_file_type", *_HOME]


def __getattr__(name: str):
    if name in _HOME:
        return getattr(importlib.import_module(f".{_HOME[name]}", __name__), name)
    raise AttributeError(name)


def get_file_type(path: str) -> tuple[str, str]:
    """Kind ("nev" or "nsx") and version of a recording file."""
    from .sources.files import open_input
    from .specs import file_type

    with open_input(path) as f:
        return file_type(f.read(10))
