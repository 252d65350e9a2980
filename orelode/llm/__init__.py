"""Training-data operators: language ID, fingerprints, filters, mixing, BPE, language models, archives, toxicity and near-duplicates."""
