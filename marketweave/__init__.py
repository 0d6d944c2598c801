"""Market news and portfolio analytics as set-based Spark plans."""
