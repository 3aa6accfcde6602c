"""Login-event analytics as Spark DataFrame transformations.

``operators``  DataFrame -> DataFrame building blocks
``sources``    CSV, table, JDBC and model input/output
``functions``  column expressions shared by the operators
``plans``      whole jobs: the training pipeline and the query catalogue
``streaming``  the failure rule on a Structured Streaming source
"""

from tallywatch.operators.sequence import SequenceRule, consecutive_failures
from tallywatch.session import build_session

__all__ = ["SequenceRule", "build_session", "consecutive_failures"]
