"""sparkloom: pipelines of lazy DataFrames, and relational and task-graph operators as Spark jobs."""

__version__ = "0.1.0"
