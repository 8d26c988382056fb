"""Files that the engine reads and writes: answers as JSON lines, keyed documents, the record index, stage tables."""
