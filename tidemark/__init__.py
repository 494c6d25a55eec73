"""tidemark: tiered memory analytics over conversation logs, expressed as Spark plans."""

__version__ = "0.1.0"
