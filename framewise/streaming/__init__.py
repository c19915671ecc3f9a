"""The operators that make sense on streams; each works on batch tables too."""
