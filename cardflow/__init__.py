"""cardflow: card and payment analytics as Spark DataFrame operators."""
