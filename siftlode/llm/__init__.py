"""Operators for training data; nothing else in siftlode imports this package."""
