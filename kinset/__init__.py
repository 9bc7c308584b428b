"""Set-similarity analytics and record linkage expressed as Spark DataFrame plans."""

__all__ = ["operators", "sources", "functions", "plans", "streaming"]
