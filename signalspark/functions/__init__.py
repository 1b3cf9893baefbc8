"""Column builders: functions from Column to Column, all JVM-side."""
