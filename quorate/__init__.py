"""quorate: ensemble (consensus) clustering analytics as Spark DataFrame jobs."""
