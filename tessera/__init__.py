"""tessera — business-intelligence analytics as Spark DataFrame and Column operators.

Layout
------
``tessera.sources``    readers and writers (files, JDBC, catalog tables)
``tessera.operators``  DataFrame -> DataFrame steps: prep, filters, joins, reshape,
                       aggregates, level-of-detail, table calculations, semantic layer,
                       analytics pane, UDF surface
``tessera.functions``  Column -> Column calculation functions
``tessera.streaming``  incremental refresh and Structured Streaming KPI jobs
``tessera.plans``      composed views and the registered query catalogue

Every operator returns a lazy DataFrame; planning, shuffles and execution are left
to Catalyst / AQE.
"""

from tessera.session import get_spark, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
