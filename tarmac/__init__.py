"""tarmac: a PySpark-native engine for vehicle telemetry and outage analytics."""

__version__ = "0.1.0"
