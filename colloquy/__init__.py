"""Conversation analytics as composable Spark DataFrame operators."""
