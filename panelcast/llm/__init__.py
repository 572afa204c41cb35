"""Training-data operators: deduplication, filtering, decontamination and tokenisation of text corpora."""
