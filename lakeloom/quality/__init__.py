"""Data-quality checks and validators."""
