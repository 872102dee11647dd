"""tidegrid: windowed analytics on multichannel sampled signals, built on PySpark DataFrames."""

__version__ = "0.1.0"
