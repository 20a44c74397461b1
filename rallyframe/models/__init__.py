"""Class-probability models. Each adds ``classes`` and ``probability`` arrays in class order."""
