"""All registered queries, once their modules are imported."""

from folialis.plans import field_queries, library_queries, request_queries  # noqa: F401
from folialis.plans.registry import QUERIES, SQL  # noqa: F401
