"""Analytics over conversational and document text, written as Spark DataFrame programs."""
