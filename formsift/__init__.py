"""Data quality of form-extraction results as Spark jobs."""
