"""Sources: JSON table documents, ground truth, CSV folders, link files, and
lakes derived from the driver's parquet tables."""
