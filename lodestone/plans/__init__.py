"""Query entry points: functions of DataFrames."""
