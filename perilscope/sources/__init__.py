"""Reading records and measurements, and the restartable measurement sink."""
