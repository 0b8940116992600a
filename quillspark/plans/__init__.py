

from . import catalogue, page_queries  # noqa: E402, F401  (the second registers its queries in the first)
