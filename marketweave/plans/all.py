"""Importing this registers all queries of this folder."""

from . import entities, evidence, portfolio, relational, sources, summaries, text  # noqa: F401
