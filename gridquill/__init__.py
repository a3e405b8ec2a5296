"""gridquill: a Spark-native engine for metric chunk tables.

Every operator takes and returns DataFrames, so Catalyst sees one declarative
plan.  Nothing here imports ``gridquill.llm``; that subpackage may be absent.
"""

__version__ = "0.1.0"
