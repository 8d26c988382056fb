"""Deliveries that arrive while the engine runs."""
