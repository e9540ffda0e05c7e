"""shelfcast: retail demand analytics and forecasting on Spark.

Every operator is a lazy ``DataFrame -> DataFrame`` function built from
Catalyst expressions (and MLlib for model fitting); actions only happen in
the job drivers under :mod:`shelfcast.plans` and in sinks.

Layout
------
``sources``    readers, the fixture views over the driver tables, sinks, model store
``functions``  column-expression helpers (rounding, guarded parsing, calendars, bins)
``operators``  cleaning, exploration aggregates, features, dataset prep, modelling,
               evaluation and batch scoring
``plans``      the end-to-end batch job and the driver query catalogue
``streaming``  the same ingest operators applied to a file stream
"""

__version__ = "0.1.0"
