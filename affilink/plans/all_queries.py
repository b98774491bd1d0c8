"""Every query of the core: importing a module adds its queries."""

from affilink.plans import queries, registry_queries  # noqa: F401
from affilink.plans.base import QUERIES, SQL  # noqa: F401
