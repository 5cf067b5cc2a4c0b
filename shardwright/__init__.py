"""shardwright: language-model training-data work as Spark jobs.

Corpus -> token shards -> document index -> batch plans -> document scores ->
selection -> evaluation packing -> run-log analytics.  Every operator is a
function ``DataFrame -> DataFrame`` built from Spark SQL expressions; grouped
Arrow/pandas functions are used only where a sequential rule has to run inside
one bounded group (one shard, one document, one rank).
"""

__version__ = "0.1.0"
