"""Position analytics on Spark: party x item matrices, text comparison, search and data checks."""
