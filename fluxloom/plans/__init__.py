"""Registered queries: each applies operators of the library to the tables of a data folder."""

from __future__ import annotations

import importlib

from fluxloom.plans.registry import ORACLES, QUERIES

for _family in ("lightcurves", "models", "numerics", "surfaces", "exchange"):
    importlib.import_module(f"fluxloom.plans.{_family}")


def flagship(spark, sf_dir):
    """Clean light curves, summarised and joined with their objects."""
    return QUERIES["clean_and_summarise"](spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
