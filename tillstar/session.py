"""Session defaults and the shared scratch folder.

On a cluster the scratch folder lives under ``spark.checkpoint.dir`` (a shared
file system path every executor can reach).  Only when that setting is absent,
as in local tests, a private temporary folder is created and registered.
"""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every tillstar job relies on; applied only when the caller did not set them.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "tillstar") -> SparkSession:
    """Session for tests and the local bench (UI off, small shuffle fan-out)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
    )
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Spark removes the shuffle files of a query when it ends, not when the driver collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A join of rows dealt by one of its keys leaves them where they are.
JOIN_BY_PART = ("spark.sql.requireAllClusterKeysForCoPartition", "false")
_tidying: dict[tuple, list] = {}
_tidying_lock = threading.Lock()


@contextmanager
def tidy_shuffles(spark: SparkSession, *more: tuple[str, str]) -> Iterator[None]:
    """Queries that end inside the block leave no shuffle files, so that a chain of jobs holds those of one
    at a time; ``more`` settings hold there too. Blocks may nest and run in threads of one session; the last
    to end restores a setting."""
    conf = ((SHUFFLE_CLEANUP, "true"), *more)
    with _tidying_lock:
        for key, value in conf:
            held = _tidying.setdefault((id(spark), key), [0, spark.conf.get(key, None)])
            held[0] += 1
            spark.conf.set(key, value)
    try:
        yield
    finally:
        with _tidying_lock:
            for key, _ in conf:
                held = _tidying[id(spark), key]
                held[0] -= 1
                if not held[0]:
                    del _tidying[id(spark), key]
                    if held[1] is None:
                        spark.conf.unset(key)
                    else:
                        spark.conf.set(key, held[1])


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    Only a local master may go without one: it then gets a private temp folder.
    Elsewhere executors would each write to their own disk, so that raises.
    """
    sc = spark.sparkContext
    root = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tillstar-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
        root = sc.getCheckpointDir() or root
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused folder below the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/tillstar/{name}-{uuid.uuid4().hex[:12]}"
