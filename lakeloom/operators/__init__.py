"""Dataflow operators: functions of DataFrames, without clock, configuration or target of their own."""
