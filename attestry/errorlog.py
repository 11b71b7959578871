"""Errors of a block of work in a file."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path


@contextmanager
def error_log(folder: str | Path, logger: str = "attestry") -> Iterator[Path]:
    """While the block runs, errors that the logger gets also go to errors.log in the folder, and so does what ends the block;
    without an error there is no file."""
    path = Path(folder) / "errors.log"
    handler = logging.FileHandler(path, delay=True, encoding="utf-8")
    handler.setLevel(logging.ERROR)
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
    log = logging.getLogger(logger)
    log.addHandler(handler)
    try:
        yield path
    except Exception:
        log.exception("stopped by an error")
        raise
    finally:
        log.removeHandler(handler)
        handler.close()
