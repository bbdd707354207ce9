"""End-to-end compositions: dataset preparation and evaluation runs."""
