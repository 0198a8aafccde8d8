"""All registered queries."""

from __future__ import annotations

from tallyframe.workload import models, relational, shortage, survey  # noqa: F401 - importing registers
from tallyframe.workload.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
