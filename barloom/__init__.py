"""barloom: rule-based equity screening and trade review as Spark DataFrame operators."""

__version__ = "0.1.0"
