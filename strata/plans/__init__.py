"""Deciding on the driver which store answers a read and how a write propagates."""
