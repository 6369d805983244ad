"""kindred: Spark-native record linkage at scale.

Subpackages: ``sources`` (readers and writers), ``functions`` (column expressions), ``operators`` (indexes, blocking,
evaluation, training pairs, profiling), ``plans`` (named queries) and ``streaming``.
"""
