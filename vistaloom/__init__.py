"""vistaloom: embedding, timeline and evaluation analytics as plain PySpark DataFrame operators."""
