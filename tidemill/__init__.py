"""Spark-native engine for curating captured web content.

Every operator is a function from DataFrame to DataFrame or from Column to Column; plans stay
declarative so that Catalyst and adaptive execution choose the physical strategy.
"""

__version__ = "0.1.0"
