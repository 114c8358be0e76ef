"""Column expressions that the operators share."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def stamp(ts: Column) -> Column:
    """A timestamp as it is compared: its text; null is empty, which loses to everything else."""
    return F.coalesce(ts.cast("string"), F.lit(""))


def newer(remote: Column, local: Column) -> Column:
    """Strictly last write: ties stay local."""
    return stamp(remote) > stamp(local)


#: How names of tables begin that are never synchronised. Fixed values.
INTERNAL = ("_", "sqlite_")


def system_time(now: datetime) -> str:
    """The form of system times: a blank between date and time."""
    return now.strftime("%Y-%m-%d %H:%M:%S")


def cutoff(now: datetime, days: int) -> str:
    return system_time(now - timedelta(days=days))


def heartbeat_time(now: datetime) -> str:
    """Noon of the day, so that it changes once a day."""
    return now.strftime("%Y-%m-%dT12:00:00.000Z")
