"""Training-data operators: scans, scoring, de-duplication, mixing and token output."""
