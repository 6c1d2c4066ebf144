"""Structured Streaming jobs for the payment and upload logs."""
