"""Training-data operators: mixing, token files, near-dedup, chat, WARC, ANN, language ID,
token counts, sharding and decontamination.  Nothing else in the library imports this package."""
