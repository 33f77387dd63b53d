"""Context compression, conversation memory and vector quantization over Spark tables."""

__version__ = "0.1.0"
