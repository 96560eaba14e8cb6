"""scanlode: code-security analytics as Spark DataFrame operators."""
