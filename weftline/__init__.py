"""Source files as tables: extract, hash, resolve, search, compare, scan and watch them with Spark."""

from weftline.engine import PROFILES, Context, Options, compare, context, context_of, security_scan, validate

__all__ = ["PROFILES", "Context", "Options", "compare", "context", "context_of", "security_scan", "validate"]
