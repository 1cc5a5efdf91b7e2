"""The query registry: name -> (plan builder, ANSI SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name; a query without SQL is tested against brute force in ``tests``."""

    def __init__(self) -> None:
        self.plans: dict[str, Plan] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None) -> Callable[[Plan], Plan]:
        def keep(plan: Plan) -> Plan:
            key = name or plan.__name__
            if key in self.plans:
                raise ValueError(f"two queries are named {key}")
            self.plans[key] = plan
            if sql is not None:
                self.sql[key] = sql
            return plan

        return keep
