"""Part of obsengine: functions."""
