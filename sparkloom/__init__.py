"""A PySpark-native engine for sets of sequences, alignments, ensembles, profiles and trees."""
