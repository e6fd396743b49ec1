"""Operators over ``units(group_no, group_name, unit_no, text)`` and line streams."""
