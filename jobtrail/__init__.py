"""Job-search analytics as Spark DataFrame functions: watch, score, tailor, apply, track."""
