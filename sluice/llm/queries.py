"""All registered queries of the package, and the SQL of those that SQL can express."""

from . import fingerprints, line_dedup, mixing, near_dedup, packing, pii, quality, secrets, suffix_dedup, token_files

MODULES = (suffix_dedup, mixing, packing, near_dedup, token_files, line_dedup, quality, fingerprints, secrets, pii)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: v for m in MODULES for k, v in getattr(m, "ORACLE", {}).items()}
