"""Content routing: every entry gets exactly one route."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverlog.functions.values import field_text
from riverlog.model import Route, require, require_rules

ROUTE = "route"


def route_expression(routes: Sequence[Route], fallback: str | None = None) -> Column:
    """Name of the route an entry takes, NULL when none claims it.

    Fields are tried in order of first mention.  Within one field the last
    route that lists a value owns it.  Values compare with their case.
    """
    require_rules("route", routes)
    owners: dict[str, dict[str, str]] = {}
    for position, rule in enumerate(routes):
        require(rule.field != "", f"route[{position}]: the field must not be empty")
        require(len(rule.values) > 0, f"route[{position}]: no values for field {rule.field!r}")
        require(rule.name != "", f"route[{position}]: no destination for field {rule.field!r}")
        for value in rule.values:
            owners.setdefault(rule.field, {})[value] = rule.name

    choices = []
    for field, by_value in owners.items():
        text = field_text(field)
        destinations: dict[str, list[str]] = {}
        for value, name in by_value.items():
            destinations.setdefault(name, []).append(value)
        choice = None
        for name, values in destinations.items():
            test = text.isin(*values)
            choice = F.when(test, name) if choice is None else choice.when(test, name)
        choices.append(choice)
    if fallback is not None:
        choices.append(F.lit(fallback))
    return F.coalesce(*choices)


def route(df: DataFrame, routes: Sequence[Route], fallback: str | None = None) -> DataFrame:
    """Add a ``route`` column; entries that no route claims are dropped unless
    there is a fallback.  Split with ``where(route = ...)`` or write the result
    partitioned by ``route`` to serve all destinations in one pass.
    """
    routed = df.withColumn(ROUTE, route_expression(routes, fallback))
    return routed if fallback is not None else routed.where(F.col(ROUTE).isNotNull())
