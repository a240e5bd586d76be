"""SQL over DataFrames named for one call."""

from __future__ import annotations

import threading
import uuid
from contextlib import ExitStack

from pyspark.sql import DataFrame, SparkSession

_LOCK = threading.RLock()


def sql(query: str, /, **tables: DataFrame) -> DataFrame:
    """The result of a Spark SQL query in which each keyword names a table.

    The names exist during analysis only: views that they shadow come back, and no
    two calls see each other's.
    """
    if not tables:
        session = SparkSession.active()
        return session.sql(query)
    session = next(iter(tables.values())).sparkSession
    with _LOCK, ExitStack() as after:
        for name, df in tables.items():
            if session.catalog._jcatalog.tableExists(name) and any(t.name == name and t.isTemporary for t in session.catalog.listTables()):
                held = session.table(name)
                after.callback(lambda n=name, h=held: h.createOrReplaceTempView(n))
            else:
                after.callback(session.catalog.dropTempView, name)
            df.createOrReplaceTempView(name)
        return session.sql(query)


def unique(prefix: str) -> str:
    """A column or view name that nothing else has."""
    return f"{prefix}_{uuid.uuid4().hex}"
