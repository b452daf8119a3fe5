"""querl: a small, strictly typed analytics engine expressed as Spark plans."""
