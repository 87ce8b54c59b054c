"""Cohort, early-window feature and outcome-audit operators for Spark.

Every operator takes DataFrames and returns lazy DataFrames.  The layers are

* ``functions``  Column -> Column helpers
* ``sources``    table bindings, file readers and writers
* ``operators``  one module per stage (cohort, window, labels, features, ...)
* ``plans``      end-to-end builds and the query registry
"""

from staylens.session import build_session, settle, tune

__all__ = ["build_session", "settle", "tune"]
