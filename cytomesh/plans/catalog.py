"""Imports every plan module, which registers its queries."""

from cytomesh.plans import agreement, aggregates, modelling, spatial, tables  # noqa: F401
