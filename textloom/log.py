"""Logging to the console and, a JSON object a line, to a file that starts anew at a size."""

from __future__ import annotations

import json
import logging
from logging.handlers import RotatingFileHandler


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        said = {"time": self.formatTime(record), "level": record.levelname, "name": record.name, "message": record.getMessage()}
        if record.exc_info:
            said["error"] = self.formatException(record.exc_info)
        return json.dumps(said)


def set_up(level: str = "INFO", path: str | None = None, most_bytes: int = 10_000_000, backups: int = 5) -> logging.Logger:
    logger = logging.getLogger("textloom")
    logger.setLevel(level)
    logger.handlers.clear()
    logger.addHandler(logging.StreamHandler())
    if path:
        own = RotatingFileHandler(path, maxBytes=most_bytes, backupCount=backups)
        own.setFormatter(JsonLines())
        logger.addHandler(own)
    return logger
