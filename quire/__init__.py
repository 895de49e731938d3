"""quire: a Spark-native engine for document catalogues (cleaning, metadata, search, limits, glyphs)."""

__version__ = "0.1.0"
