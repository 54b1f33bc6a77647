"""Small helpers that several test modules import by name."""

from __future__ import annotations

from datetime import datetime, timedelta

START = datetime(2024, 1, 1)


def at(hours: float, start: datetime = START) -> datetime:
    return start + timedelta(hours=hours)


def rows_by(frame, *keys):
    """Collected rows as dicts, keyed by one or several columns."""
    return {
        (tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]): r.asDict() for r in frame.collect()
    }
