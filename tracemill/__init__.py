"""Analytics over records of model calls, and over text corpora, as Spark plans."""
