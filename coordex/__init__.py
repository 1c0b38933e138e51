"""coordex: repeated 3-D coordinate measurements as Spark plans."""
