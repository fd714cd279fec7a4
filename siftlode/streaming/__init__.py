"""streaming of siftlode."""
