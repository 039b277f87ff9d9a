"""recolens: recommendation analytics as Spark DataFrame plans.

Every public operator is a function ``DataFrame -> DataFrame`` (or a small
family of them) built from Spark SQL expressions, joins, aggregations and
windows.  Sub-packages:

* ``sources``   - readers and writers (CSV with encoding fallback, dictionary
                  files, embeddings, models, result tables).
* ``functions`` - Column-level helpers: text cleaning, rating parsing,
                  column-name normalisation.
* ``operators`` - relational operators: lexicon mapping, corpus building,
                  TF-IDF, similarity top-k, co-reviewer overlap, ranking
                  metrics, ALS factor models, dense id encoding.
* ``plans``     - end-to-end plans over the driver tables and the serving
                  entry points (search / similar / recommend).
* ``streaming`` - incremental (micro-batch) forms of the ingest steps.
"""

from recolens.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
