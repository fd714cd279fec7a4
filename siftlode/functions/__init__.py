"""functions of siftlode."""
