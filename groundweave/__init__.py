"""Spark jobs for image-block adjustment, embedding evaluation and corpus preparation."""
