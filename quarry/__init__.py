"""A query engine for telemetry on Spark: metrics, logs, traces and profiles."""
