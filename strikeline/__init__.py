"""Options-chain analytics as Spark DataFrame operators."""
