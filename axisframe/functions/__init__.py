"""Part of axisframe."""
