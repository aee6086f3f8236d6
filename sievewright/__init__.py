"""sievewright: a PySpark engine that curates text corpora and evaluates models trained on them."""

__version__ = "0.1.0"
