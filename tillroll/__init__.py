"""Retail customer analytics as Spark DataFrame jobs: profiling, cleaning,
RFM features and churn, place / people / product / growth analysis, and
k-means customer segmentation."""

__version__ = "0.1.0"
