"""Code-observability analytics expressed as Spark DataFrame plans."""
