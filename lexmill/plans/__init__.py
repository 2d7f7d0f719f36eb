"""Named queries over the standard tables."""

from importlib import import_module

MODULES = ("usage", "texts", "findings", "comparison", "sources", "proof", "templates", "extras", "scalars", "reviewing", "wider", "more", "pages")


def all_queries():
    """The registry, with the queries of all modules in it."""
    for m in MODULES:
        import_module(f"lexmill.plans.{m}")
    return import_module("lexmill.plans.registry")
