"""talespan: a PySpark library for time-coded spoken-word archives and text corpora."""
