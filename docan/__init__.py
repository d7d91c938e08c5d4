"""docan: document-analytics operators expressed as PySpark DataFrame plans."""
