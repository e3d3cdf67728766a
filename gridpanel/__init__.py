"""PySpark operators for hourly power-system panels and scenario ensembles."""
