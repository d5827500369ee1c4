"""Python workers: what they can import, how much they hold, how they work ahead and what they log."""

from __future__ import annotations

import logging
import os
import queue
import threading
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path
from typing import TypeVar

from pyspark.sql import SparkSession

Item = TypeVar("Item")

#: Most bytes of an Arrow batch, unless the session has a smaller bound: rows carry pictures and whole files.
BATCH_BYTES = 8 << 20


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package where it isn't installed: its parent goes on their path.
    Arrow batches get a bound in bytes."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(bound, "67108864b"))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(bound, str(BATCH_BYTES))
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, *have) if x)


def ahead(items: Iterable[Item], depth: int = 2) -> Iterator[Item]:
    """``items``, made by a thread that is at most ``depth`` of them ahead; what it raises is raised here.
    A reader that stops early stops the thread."""
    made: queue.Queue = queue.Queue(depth)
    left = threading.Event()

    def hand_over(said: tuple) -> None:
        while not left.is_set():
            try:
                return made.put(said, timeout=0.1)
            except queue.Full:
                pass

    def work() -> None:
        try:
            for item in items:
                hand_over((item, None))
                if left.is_set():
                    return
            hand_over((None, StopIteration()))
        except BaseException as e:  # goes on in the reader's thread
            hand_over((None, e))

    thread = threading.Thread(target=work, daemon=True)
    thread.start()
    try:
        while True:
            item, error = made.get()
            if isinstance(error, StopIteration):
                return
            if error is not None:
                raise error
            yield item
    finally:
        left.set()
        thread.join()


@contextmanager
def logged(what: str) -> Iterator[None]:
    """Errors are logged with what was being done, and go on: the task fails and runs again."""
    try:
        yield
    except Exception:
        logging.getLogger("docloom").exception("%s failed", what)
        raise
