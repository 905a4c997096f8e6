"""quarrymill: search and document analytics expressed as Spark DataFrame plans."""
