"""Viewing analytics on Spark: conformance, roll-ups, reports and entitlements."""
