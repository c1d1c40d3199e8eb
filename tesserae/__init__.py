"""Raster-relational risk analytics and corpus preparation on PySpark."""
