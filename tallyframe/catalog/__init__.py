"""Registered queries over the driver tables, each with the SQL it must equal."""

from tallyframe.catalog import (  # noqa: F401
    aggregates, cleaning, clustering, groups, models, ordered, scalars, selection, spatial, treatments,
)
from tallyframe.catalog.registry import COVERAGE, ORACLES, QUERIES  # noqa: F401
