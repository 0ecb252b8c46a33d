"""riskloom: explainable fraud-risk analytics as Spark table-to-table jobs."""

__version__ = "0.1.0"
