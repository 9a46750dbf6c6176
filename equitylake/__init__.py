"""equitylake: a Spark-native store and query engine for equity market data.

Modules: ``functions.parsers`` (typed value parsers as Columns),
``operators`` (page scanning, property assignment, merges, metrics, fetch
log), ``sources`` (page and table sources, the versioned bucketed store),
``plans`` (views, jobs, API entry points, registered queries) and
``streaming`` (page ingest, live fetch-log resolution).
"""

__version__ = "0.1.0"

_EXPORTS = {
    "get_spark": ("equitylake.session", "get_spark"),
    "CLUSTER_CONF": ("equitylake.session", "CLUSTER_CONF"),
    "Store": ("equitylake.sources.store", "Store"),
    "ShareQuery": ("equitylake.plans.views", "ShareQuery"),
    "current_view": ("equitylake.plans.views", "current_view"),
    "query_shares": ("equitylake.plans.views", "query_shares"),
    "stale_set": ("equitylake.plans.views", "stale_set"),
    "discover": ("equitylake.plans.jobs", "discover"),
    "refresh": ("equitylake.plans.jobs", "refresh"),
    "refresh_all": ("equitylake.plans.jobs", "refresh_all"),
}
__all__ = sorted(_EXPORTS)


def __getattr__(name):
    # lazy: importing the package does not start or touch Spark
    if name in _EXPORTS:
        import importlib
        module, attr = _EXPORTS[name]
        return getattr(importlib.import_module(module), attr)
    raise AttributeError(name)
