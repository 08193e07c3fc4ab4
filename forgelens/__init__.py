"""Software-repository mining and risk analytics as composable Spark plans."""

__version__ = "0.1.0"
