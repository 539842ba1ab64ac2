"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.session import work_dir

# Tasks get the helpers with their function, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def ship(module: str) -> None:
    """Let tasks carry the functions of a module instead of importing it."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def worker_cache(name: str) -> dict:
    """A dictionary that outlives the tasks of a Python worker, until another name is asked for.

    Functions shipped by value get new globals with every task; this module object stays. A worker runs the steps of
    a pipeline one after the other, so what an earlier step kept would only add to the memory of the next.
    """
    holder = sys.modules.setdefault("_caseflow_worker_cache", types.ModuleType("_caseflow_worker_cache"))
    made = holder.__dict__.setdefault("made", {})
    if name not in made:
        made.clear()
    return made.setdefault(name, {})


def give_back() -> None:
    """Return to the system what Arrow keeps of batches that are gone; a Python worker that waits for its next task
    would hold it beside the later steps."""
    pa.default_memory_pool().release_unused()


def fold(key: str, modulus: int) -> Column:
    """crc32 of a key written as text, modulo a number; NULL for a NULL key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus


def replace_columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns; columns of the same name (whatever their case) give way."""
    taken = {name.lower() for name in columns}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    return df.select(*kept, *[value.alias(name) for name, value in columns.items()])


def free(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of a table has, so that helper columns hide none of its own."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table into the shared folder and read it back: later steps survive lost executors."""
    path = f"{work_dir(df.sparkSession, purpose)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
