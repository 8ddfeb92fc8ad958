"""Data files of the package (word lists, page markers); a caller's folder in SIFTLINE_DATA replaces them one by one."""

from __future__ import annotations

import os
import pkgutil
from pathlib import Path


def text(name: str) -> str:
    own = os.environ.get("SIFTLINE_DATA")
    if own and (Path(own) / name).exists():
        return (Path(own) / name).read_text(encoding="utf-8")
    return pkgutil.get_data("siftline", f"data/{name}").decode("utf-8")
