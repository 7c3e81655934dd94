"""A worker that builds indexes beside the writers."""

from __future__ import annotations

import threading

from doclattice.engine import Engine


def run_worker(engine: Engine, stop: threading.Event, every: float = 5.0, timeout: float = 10.0) -> None:
    """Build pending indexes, look again after `every` seconds, and end when `stop` is set. timeout:
    seconds after which an index that another worker has taken counts as left."""
    while not stop.is_set():
        engine.build_pending(timeout)
        stop.wait(every)
