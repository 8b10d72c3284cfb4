"""Registered queries: one callable per operator plus the equivalent SQL where there is one."""

from tablesteps.queries.base import REGISTRY, Tables, query  # noqa: F401


def load() -> dict:
    """Import every query module and return the registry."""
    from tablesteps.queries import corpus, families, graph, ledgers, reconciling, scalars, storage, steps  # noqa: F401

    return REGISTRY
