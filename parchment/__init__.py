"""Set-based Spark operators for report, batch and document data."""
