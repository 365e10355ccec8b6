"""panelspark: entity x category x period panel analytics on PySpark DataFrames."""
