"""helixgrid: single-cell read processing and interval analytics as Spark DataFrame plans."""
