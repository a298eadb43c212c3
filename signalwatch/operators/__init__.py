"""operators of signalwatch."""
