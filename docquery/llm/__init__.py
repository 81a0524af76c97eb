"""Training-data operators: language ID, token files, personal data, secrets, duplicates, packing, sharding, quality and decontamination."""
