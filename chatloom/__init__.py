"""Live-chat analytics as composable PySpark DataFrame operators."""
