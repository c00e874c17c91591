"""Analytics over the records of deliberative bodies, on Spark."""
