"""Part of flowspar."""
