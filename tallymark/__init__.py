"""Sales analytics on Spark: tolerant scan, profile, quality, cleaning, analysis specs, facts."""
