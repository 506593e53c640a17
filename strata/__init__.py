"""strata: layered reads and writes for Spark tables, proven on the driver and executed by Catalyst."""
