"""Table-level operators, all of the form ``DataFrame -> DataFrame``."""
