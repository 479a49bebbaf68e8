"""Training-data operators: toxicity, chat examples, mixing, language, packing, near copies, quality, PII, archives, set joins."""
