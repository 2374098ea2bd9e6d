"""Wrappers for calls of remote models, used inside workers: retries and throttling."""

from __future__ import annotations

import random
import time
from collections.abc import Callable


def retrying(call: Callable, attempts: int = 5, least: float = 2.0, most: float = 60.0, on: tuple[type[BaseException], ...] = (ConnectionError, TimeoutError), sleep: Callable[[float], None] = time.sleep) -> Callable:
    """Repeat ``call`` after the named failures, waiting a random time whose bound doubles. A Spark
    task may run again besides, so the call has to bear repetition."""

    def run(*args):
        for attempt in range(1, attempts + 1):
            try:
                return call(*args)
            except on:
                if attempt == attempts:
                    raise
                sleep(max(least, random.uniform(0, min(most, least * 2**attempt))))
        return None

    return run


def throttled(call: Callable, seconds: float, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> Callable:
    """At most one call per ``seconds`` in each worker."""
    last = [-float("inf")]

    def run(*args):
        wait = last[0] + seconds - clock()
        if wait > 0:
            sleep(wait)
        last[0] = clock()
        return call(*args)

    return run


def has_model(installed: list[str], wanted: str) -> bool:
    """Whether a server's list of models has one whose name contains the wanted one."""
    return any(wanted in name for name in installed)
