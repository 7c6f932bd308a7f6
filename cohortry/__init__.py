"""Customer-lifecycle analytics as PySpark DataFrame operators.

``sources``    where frames come from and where results are written
``functions``  Column-level building blocks
``operators``  DataFrame -> DataFrame analytics
``plans``      multi-stage reports built from the operators
``catalog``    the registered queries and their SQL counterparts
"""
