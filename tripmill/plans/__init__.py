"""Compositions of the operators, and the catalogue of named queries."""

from importlib import import_module

CATALOGUE = ["trips", "trip_masks", "shapes", "trip_noise", "datasets", "scores", "models", "files", "tables"]


def register_all() -> None:
    for name in CATALOGUE:
        import_module(f"tripmill.plans.{name}")
