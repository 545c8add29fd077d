"""factloom: truth discovery over noisy product claims, expressed as Spark DataFrame plans."""
