"""Graph risk-reduction analytics on Spark."""
