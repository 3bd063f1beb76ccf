"""Typed sources (CSV / parquet catalogue, order-shaped tables derived from
the driver's star schema) and sinks."""
