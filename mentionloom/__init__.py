"""Document annotation, set fusion and record shaping as Spark jobs."""

__version__ = "0.1.0"
