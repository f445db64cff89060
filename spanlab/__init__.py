"""spanlab: span-annotated corpora and sequence-label evaluation on Spark.

Entry points: ``spanlab.plans.registry.REGISTRY`` (every query with its
DuckDB oracle) and ``spanlab.plans.lineage.lineage(spark, sf_dir)`` (the
shared corpus -> spans -> tokens -> aligned -> pairs lineage).
"""
