"""Part of the funding-catalog library: functions."""
