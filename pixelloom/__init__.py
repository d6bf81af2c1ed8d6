"""PySpark-native analytics engine for rasters, numeric arrays, boxes, points and text."""
