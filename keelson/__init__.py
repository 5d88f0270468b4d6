"""keelson: schema drift, type conversion and table transfer on Spark DataFrames."""

__version__ = "0.1.0"
