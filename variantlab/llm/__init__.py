"""Operations that a training-data pipeline needs, each a Spark job.

Nothing else in the package imports this subpackage.
"""
