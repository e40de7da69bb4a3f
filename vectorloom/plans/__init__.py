"""Building blocks that shape plans, and the pipelines composed from the operators."""
