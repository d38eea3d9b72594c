"""lattica: Spark DataFrame operators for posts that share recurring templates."""
