"""tarnbeck: evidence-corpus and company-research analytics as Spark DataFrame operators."""
