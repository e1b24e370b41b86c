"""Column functions over the access log: decoding, classification, event fields, visitor identity."""
