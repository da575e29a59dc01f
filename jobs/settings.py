"""What the jobs' command lines share: settings from a small JSON file, a session, a log."""

from __future__ import annotations

import json
import logging
from dataclasses import fields
from pathlib import Path
from typing import TypeVar

S = TypeVar("S")


def load(kind: type[S], path: str) -> S:
    """Settings of a dataclass from a JSON object; names that it doesn't have are an error."""
    found = json.loads(Path(path).read_text(encoding="utf-8"))
    known = {f.name for f in fields(kind)}
    if unknown := sorted(set(found) - known):
        raise ValueError(f"unknown settings {unknown}; there are {sorted(known)}")
    return kind(**found)


def start(app: str):
    """The command line's session; its master and other settings come from spark-submit or the defaults file."""
    from trailforge.session import get_session

    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    return get_session(app)
