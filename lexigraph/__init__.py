"""Lexigraph: a Spark-native engine for multi-source catalogues.

Every operator takes and returns DataFrames. Nothing in this package imports
the optional subpackage ``lexigraph.llm``.
"""

__version__ = "0.1.0"
