"""Column functions: strict response parsing, canonical JSON and digests, prompts, text."""
