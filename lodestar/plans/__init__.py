"""Logical plans that wire operators into the pipeline and its fixtures."""
