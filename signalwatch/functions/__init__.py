"""functions of signalwatch."""
