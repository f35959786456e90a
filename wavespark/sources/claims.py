"""Claims: which load may write which versions of a project.

Two loads that start at once see the same latest version.  Before it writes
anything, a load claims consecutive versions by creating one file, named after
the first of them, which only one of several can do.  The others find it taken,
read how many versions it stands for, and go on behind them; so claims divide
the numbers from 1 on without gap or overlap, and the walk is as long as there
are loads in flight.

A claim names the change it is for (files and modification times).  A load of
the same change that is still running makes a second one step back; one that
died is taken over by a retry, which then writes the same versions again.  A
claim nobody retries leaves its numbers unused.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from ..session import create_exclusive, read_text

#: Seconds after which another application's claim without versions counts as dead.
STALE_SECONDS = 6 * 3600.0

_LIVE: set[str] = set()
_LOCK = threading.Lock()


@contextmanager
def load() -> Iterator[str]:
    """The name of a load, which counts as running inside the context."""
    name = uuid.uuid4().hex
    with _LOCK:
        _LIVE.add(name)
    try:
        yield name
    finally:
        with _LOCK:
            _LIVE.discard(name)


def _running(held: dict, application: str, now: float) -> bool:
    with _LOCK:
        if held["application"] == application:
            return held["load"] in _LIVE
    return now - held["at"] < STALE_SECONDS


def claim(spark: SparkSession, folder: str, name: str, change: str, latest: int, count: int) -> int | None:
    """The first of ``count`` versions above ``latest`` that now belong to the
    load ``name``; None if a running load has claimed the same ``change``."""
    application = spark.sparkContext.applicationId
    mine = json.dumps({"application": application, "load": name, "change": change, "count": count, "at": time.time()})
    first, turn = latest + 1, 0
    while not create_exclusive(spark, f"{folder}/{first:010d}.{turn}", mine):
        held = json.loads(read_text(spark, f"{folder}/{first:010d}.{turn}"))
        if held["change"] != change:
            first, turn = first + held["count"], 0
        elif _running(held, application, time.time()):
            return None
        else:
            turn += 1  # a load of this change that died: taken over, by one retry only
    return first
