"""sources of signalwatch."""
