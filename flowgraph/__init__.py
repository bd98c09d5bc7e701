"""Document-flow graph analytics on Spark.

Order-to-cash documents are loaded as JSON lines, projected into a typed
property graph, and queried: flow checks, neighbours, k-hop subgraphs,
integrity audits and batch question triage.  Every operator is a function
from DataFrames to DataFrames.
"""
