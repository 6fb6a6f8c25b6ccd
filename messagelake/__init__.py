"""Message-history analytics as Spark DataFrame operators."""
