"""Training-data operators: archives, token counts, near copies, privacy, fingerprints,
mixing, toxicity, byte-level BPE, language and media columns.  Nothing else in the
library imports this subpackage."""
