"""Every query over the shared tables, with the SQL it is compared with."""

from importlib import import_module
from pkgutil import iter_modules


def load() -> None:
    """Imports all modules of queries, which register themselves."""
    for module in iter_modules(__path__, f"{__name__}."):
        import_module(module.name)
