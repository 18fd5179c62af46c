"""Named queries over the role views."""


def load_catalog():
    """(queries, oracle SQL) with every query module registered."""
    from importlib import import_module
    from . import catalog
    for module in MODULES:
        import_module(f"{__name__}.{module}")
    return catalog.QUERIES, catalog.ORACLES


MODULES = ["tables_and_joins", "features_and_cubes", "labels_and_audits", "metrics_and_policy", "statistics_and_models", "streams"]
