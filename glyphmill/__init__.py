"""PySpark-native engine for glyph-mosaic encoding, decoding and the relational work around it."""
