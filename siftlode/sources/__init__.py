"""sources of siftlode."""
