"""The registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import binaries, delivery, live, manifests, scalars, tagged  # noqa: F401  (they register their queries)
    from . import registry as q

    return dict(q.QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import binaries, delivery, live, manifests, scalars, tagged  # noqa: F401  (they register their queries)
    from . import registry as q

    return dict(q.SQL)
