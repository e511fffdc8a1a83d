"""Conversation-log analytics on Spark: scans, redaction, triggers, distillation and evaluation as DataFrame plans."""
