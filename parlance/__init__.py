"""Conversation-data engine on PySpark."""
