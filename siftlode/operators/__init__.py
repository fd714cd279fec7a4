"""operators of siftlode."""
