"""Training-data operators: near-duplicate joins, language-model scores, media, secrets, packing and the like."""
