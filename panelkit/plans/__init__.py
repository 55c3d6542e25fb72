"""Registered end-to-end queries: ``QUERIES[name](spark, sf_dir) -> DataFrame`` and,
where the result is SQL-expressible, ``ORACLE[name]`` (DuckDB SQL over the
driver tables).  Importing this package registers every query module."""

from panelkit.plans.registry import ORACLE, QUERIES  # noqa: F401
from panelkit.plans import q_io, q_panel, q_describe, q_regression, q_did  # noqa: F401,E402
