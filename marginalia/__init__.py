"""marginalia: bibliography analytics as Spark columns, tables and queries."""

__version__ = "0.1.0"
