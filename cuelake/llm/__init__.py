"""Training-data pipeline operators: mixing, archives, sharding, chat, language, toxicity, dedup, quality, rules, decontamination,
neighbours, Merkle manifest, whitening."""
