"""Where documents come from and where results go."""

from palimpsest.sources.files import read_text_files, read_tokens, write_cleaned, write_tokens
from palimpsest.sources.reports import findings_json, findings_tsv

__all__ = ["findings_json", "findings_tsv", "read_text_files", "read_tokens", "write_cleaned", "write_tokens"]
