"""Evidence-first question answering over property graphs, as Spark plans."""
