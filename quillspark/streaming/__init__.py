"""Notifications of running evaluations, and queries over streams."""
