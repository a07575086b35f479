"""Whole jobs and the registered queries, composed from the operators."""

from __future__ import annotations

from fieldloom.plans.registry import Registry


def all_queries() -> Registry:
    """Every registered query of the crop-yield library."""
    from fieldloom.plans import fields, learning, yields

    registry = Registry()
    for module in (yields, fields, learning):
        registry.merge(module.REGISTRY)
    return registry
