"""strandflow: Spark-native signal, sequence, graph and corpus analytics."""

__version__ = "0.1.0"
