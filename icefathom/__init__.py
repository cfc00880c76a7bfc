"""icefathom: polar maritime analytics as plain Spark DataFrame jobs."""

from icefathom.session import apply_defaults, build_session, ensure_checkpoint_dir

__all__ = ["apply_defaults", "build_session", "ensure_checkpoint_dir"]
