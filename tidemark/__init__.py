"""Token-launch analytics as DataFrame functions on Spark."""
