"""Whole plans: fixed tables, the driver-table views, reports and runs."""
