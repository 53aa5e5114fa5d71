"""Settings from strings, as command lines and configuration files give them, and a log of a run."""

from __future__ import annotations

import logging
import os
import time

#: Spellings of yes and no.
YES, NO = ("1", "true", "t", "yes", "y", "sim", "s"), ("0", "false", "f", "no", "n", "nao", "não")
log = logging.getLogger(__name__)


def whole(value: str | None, default: int) -> int:
    """A whole number above 0, else the default."""
    try:
        number = int((value or "").strip() or default)
    except ValueError:
        log.warning("%r is no number, using %s", value, default)
        return default
    return number if number > 0 else default


def flag(value: str | None, default: bool) -> bool:
    """Yes or no in a few spellings, else the default."""
    said = (value or "").strip().lower()
    if said in YES:
        return True
    if said in NO:
        return False
    if said:
        log.warning("%r is neither yes nor no, using %s", value, default)
    return default


def choice(value: str | None, known: tuple[str, ...], default: str) -> str:
    """One of the known words, else the default."""
    said = (value or "").strip().lower()
    if said and said not in known:
        log.warning("%r is none of %s, using %s", value, known, default)
    return said if said in known else default


def path(value: str | None, default: str, root: str = ".") -> str:
    """A path; one that isn't absolute is below the root."""
    said = (value or "").strip() or default
    return said if os.path.isabs(said) or "://" in said else os.path.join(root, said)


def log_name(prefix: str = "run", now: float | None = None) -> str:
    """A log's file name with the time."""
    return f"{prefix}_{time.strftime('%Y%m%d_%H%M%S', time.localtime(now))}.log"


def start_log(folder: str, level: int = logging.INFO, prefix: str = "run") -> str:
    """Logs go to a new file of the folder and to the console, each once; returns the file."""
    os.makedirs(folder, exist_ok=True)
    file, root = os.path.join(folder, log_name(prefix)), logging.getLogger("granella")
    stop_log()
    form = logging.Formatter("%(asctime)s | %(levelname)s | %(name)s | %(message)s")
    for handler in (logging.FileHandler(file, encoding="utf-8"), logging.StreamHandler()):
        handler.setFormatter(form)
        root.addHandler(handler)
    root.setLevel(level)
    return file


def stop_log() -> None:
    """Closes the handlers of a started log."""
    root = logging.getLogger("granella")
    for handler in list(root.handlers):
        root.removeHandler(handler)
        handler.close()
