"""Queries over the test tables; importing this package registers all of them."""

from loomgraph.plans import more, queries  # noqa: F401
