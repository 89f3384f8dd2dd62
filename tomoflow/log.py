"""Logs of a run: the console, two files, and optionally a log server."""

from __future__ import annotations

import json
import logging
import logging.handlers
import sys
import time
from pathlib import Path

NAME = "tomoflow"
FORMAT = "%(asctime)s | %(levelname)s | %(message)s"


class ServerHandler(logging.handlers.SocketHandler):
    """One JSON object a record, closed by a zero byte, over TCP."""

    def makePickle(self, record: logging.LogRecord) -> bytes:
        entry = {"version": "1.1", "host": NAME, "short_message": record.getMessage(), "timestamp": time.time(), "level": record.levelno}
        return json.dumps(entry).encode() + b"\0"


def setup(folder: str | Path | None = None, server: tuple[str, int] | None = None) -> logging.Logger:
    """Console from INFO on; in ``folder`` (of the driver) user.log from INFO and debug.log from DEBUG on."""
    log = logging.getLogger(NAME)
    log.setLevel(logging.DEBUG)
    log.handlers.clear()
    handlers: list[tuple[logging.Handler, int]] = [(logging.StreamHandler(sys.stdout), logging.INFO)]
    if folder is not None:
        Path(folder).mkdir(parents=True, exist_ok=True)
        handlers += [(logging.FileHandler(Path(folder) / name), level) for name, level in (("user.log", logging.INFO), ("debug.log", logging.DEBUG))]
    if server is not None:
        handlers.append((ServerHandler(*server), logging.INFO))
    for handler, level in handlers:
        handler.setLevel(level)
        handler.setFormatter(logging.Formatter(FORMAT))
        log.addHandler(handler)
    return log
