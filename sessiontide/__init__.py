"""Analytics of assistant-session telemetry on Spark."""
