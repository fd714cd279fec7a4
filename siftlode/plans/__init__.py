"""plans of siftlode."""
