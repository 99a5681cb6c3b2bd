"""Training-data operators: scanning, de-duplication, filtering, tokenising and packing of text corpora."""
