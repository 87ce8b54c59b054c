"""Operators of a training-data pipeline over documents and web pages.

Nothing outside this package imports it.  Operators take and return DataFrames;
those that read an intermediate table more than once write it with ``settle``
to the shared folder named by ``spark.checkpoint.dir``, so they run jobs when
called.
"""
