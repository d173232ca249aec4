"""cairn: a Spark-native document retrieval and text analytics engine."""

__all__ = ["operators", "sources", "functions", "plans", "streaming"]
