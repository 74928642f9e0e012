"""cribra: clinical-trial registry processing as Spark DataFrame jobs.

Studies land in Bronze (idempotent upsert keyed by trial id, run ledger, safe
incremental watermark); eligibility prose becomes one typed Silver row per
criterion under a content signature; progress, field statistics and registry
filters are answered as DataFrame / SQL queries.

Every operator is a pure function ``DataFrame -> DataFrame`` that takes its
key and column names as arguments.
"""

__version__ = "0.1.0"
