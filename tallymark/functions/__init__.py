"""Column expressions: hashing, text, arrays, prompts."""
