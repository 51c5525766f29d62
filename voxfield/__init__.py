"""voxfield: opinion and training-data analytics expressed as Spark DataFrame plans."""
