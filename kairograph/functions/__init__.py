"""Column functions: tolerant comparison, clocks, interval unions."""
