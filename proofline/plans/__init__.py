"""Composed jobs and the registry of named queries."""


def load_catalog():
    """Import every module that registers queries and return the registry."""
    import importlib

    from proofline.plans import catalog

    for name in ("sources", "units", "lint", "prose", "references", "versions", "history", "charts", "layout",
                 "code", "streams"):
        try:
            importlib.import_module(f"proofline.plans.queries_{name}")
        except ModuleNotFoundError as missing:
            if not str(missing.name).startswith("proofline.plans.queries_"):
                raise
    return catalog
