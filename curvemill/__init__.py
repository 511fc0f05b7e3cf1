"""A PySpark-native engine for distribution curves: entities described by fixed-support cumulative curves and by features aggregated from many observations."""
