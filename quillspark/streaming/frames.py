"""Queries over streams: the commands that look at one row at a time, over frames that go on."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..errors import EngineError
from ..operators.frame import OrderedFrame
from ..plans.planner import Planner

#: Commands that need no order and no other row.
ROWWISE = ("select_columns", "drop_columns", "eq", "ne", "gt", "gte", "lt", "lte", "contains", "startswith", "endswith", "isnull", "notnull", "rename", "cast", "fill_null", "drop_nulls", "explode")


def apply_to_stream(engine, stream: DataFrame, query: str) -> DataFrame:
    """A streaming DataFrame under a query of row-wise pl commands; the caller starts it with writeStream."""
    plan = Planner(engine.registry).plan(query)
    value = OrderedFrame(stream)
    for step in plan.steps:
        if step.kind != "action" or step.command.ns != "pl" or step.command.name not in ROWWISE:
            raise EngineError("not-supported", f"{step.command.name if step.command else step.kind} needs more than one row of a stream")
        value = engine.call(step, engine.state(value)).value
    return value.visible()
