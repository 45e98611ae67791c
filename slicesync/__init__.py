"""Table synchronisation and panel analytics as PySpark DataFrame jobs."""

from slicesync.session import build_session, run_dir, stage, workspace

__all__ = ["build_session", "run_dir", "stage", "workspace"]
