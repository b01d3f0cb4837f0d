"""Queries by name; importing this package registers them all."""

from ragloom.plans import clouds, corpus, text, vectors  # noqa: F401
from ragloom.plans.registry import QUERIES, SQL  # noqa: F401
