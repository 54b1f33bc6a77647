"""Hospital cohorts, time-windowed features and risk-model evaluation as Spark DataFrame jobs."""

__version__ = "0.1.0"
