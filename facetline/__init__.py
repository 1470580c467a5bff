"""facetline: identity timelines from face detections, on Spark DataFrames."""

__version__ = "0.1.0"
