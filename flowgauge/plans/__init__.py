"""End-to-end plans, driver-table adapters and the query catalogue."""
