"""helixmill: versioned-record analytics and text preparation on PySpark."""

__version__ = "0.1.0"
