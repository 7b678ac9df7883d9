"""obsengine: matched-observation analytics as Spark DataFrame operators."""
