"""A driver's check before a run: no other task at work, and enough memory."""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from pyspark.sql import SparkSession

from verbatik.operators import state
from verbatik.sources.config import System


def free_gb() -> float:
    return os.sysconf("SC_AVPHYS_PAGES") * os.sysconf("SC_PAGE_SIZE") / 2**30


def wait(spark: SparkSession, folder: str, settings: System, sleep: Callable[[float], None] = time.sleep) -> bool:
    """Wait until no state.json below folder says running; false if that took too long."""
    for _ in range(max(1, int(settings.max_wait_time_minutes * 60 // max(settings.task_check_interval, 1))) + 1):
        if state.running_tasks(spark, folder).isEmpty():
            return True
        sleep(settings.task_check_interval)
    return False


def ready(spark: SparkSession, folder: str, settings: System, sleep: Callable[[float], None] = time.sleep) -> bool:
    """Whether a run may begin: others have ended in time, and the least memory is free."""
    return wait(spark, folder, settings, sleep) and free_gb() >= settings.min_ram_gb
