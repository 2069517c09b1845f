"""Levelled logger over Python's logging."""

from __future__ import annotations

import logging

LEVELS = {"DEBUG": logging.DEBUG, "INFO": logging.INFO, "WARN": logging.WARNING, "ERROR": logging.ERROR, "SILENT": logging.CRITICAL + 10}


def get_logger(level: str = "INFO") -> logging.Logger:
    log = logging.getLogger("larkspur")
    if not log.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("[%(levelname)s] %(message)s"))
        log.addHandler(handler)
    log.setLevel(LEVELS[level.upper()])
    return log
