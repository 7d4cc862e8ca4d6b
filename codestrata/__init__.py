"""Analytics over source repositories and their history, as Spark plans."""
