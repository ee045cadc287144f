"""The query catalog: importing it registers every query and its SQL."""

from visitgrid.catalog.registry import ORACLES, QUERIES
from visitgrid.catalog import (cleansing, evaluation, modelling, scoring, series,  # noqa: F401
                               storage, tables)

__all__ = ["ORACLES", "QUERIES"]
