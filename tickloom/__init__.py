"""tickloom: intraday market-feature analytics expressed as Spark plans."""
