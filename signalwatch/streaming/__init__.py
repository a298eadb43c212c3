"""streaming of signalwatch."""
