"""Training-data operators: decontamination, toxicity, archives, sharding,
token counts, near duplicates, quality rules, mixing, chat windows, licences."""
